"""Schemas of the durable rows and of what every operation returns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LINE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "match")])
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType()), "lines": T.ArrayType(_LINE)}


def _struct(text: str) -> T.StructType:
    """A schema from 'name type, …', which needs no session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(", "))])


ENTRY = _struct(
    "id string, path string, external_id string, name string, parent_path string, kind string, content string, version_diff string, content_hash string, mime_type string, ext string, lines int, size_bytes long, tokens int, lexical_tokens int, line_start int, line_end int, version_number int, is_snapshot boolean, created_by string, source_path string, target_path string, edge_type string, edge_weight double, edge_distance double, embedding vector, owner_id string, original_path string, created_at timestamp, updated_at timestamp, deleted_at timestamp"
)
CANDIDATE = _struct("path string, kind string, lines lines, content string, size_bytes long, score double, in_degree long, out_degree long, updated_at timestamp")
FIELDS = tuple(CANDIDATE.fieldNames())
_LISTS = {
    "path": "glob ls tree hybrid write delete edit move copy mkdir mkedge", "content": "read", "path kind size_bytes updated_at": "stat", "path lines content": "grep", "path score": "vector_search semantic_search lexical_search bm25",
    "path score in_degree out_degree": "pagerank hits betweenness_centrality closeness_centrality degree_centrality in_degree_centrality out_degree_centrality",
    "path kind": "predecessors successors ancestors descendants neighborhood meeting_subgraph min_meeting_subgraph",
}
#: What a function shows where nothing else is asked for.
DEFAULTS = {f: tuple(fields.split()) for fields, functions in _LISTS.items() for f in functions.split()}


def missing(name: str) -> Column:
    return F.lit(None).cast(CANDIDATE[name].dataType).alias(name)
