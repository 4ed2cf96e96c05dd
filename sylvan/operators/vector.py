"""Nearest vectors by exact scores, and search by meaning over a given embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.functions.shipping import ship
from sylvan.operators.relation import Relation


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def score(vector: Column, query: Sequence[float], metric: str) -> Column:
    """cosine: their cosine, 0 where one has no length; inner: their product; l2: 1 / (1 + distance)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "inner":
        return dot(vector, q)
    if metric == "l2":
        return 1 / (1 + F.sqrt(F.aggregate(F.zip_with(vector, q, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)))
    if metric == "cosine":
        return F.coalesce(F.try_divide(dot(vector, q), F.sqrt(dot(vector, vector)) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)), F.lit(0.0))
    raise ValueError(f"unknown metric {metric!r}")


def vector_search(items: DataFrame, query: Sequence[float], k: int = 15, metric: str = "cosine", candidates: Relation | None = None, owner: str | None = None) -> Relation:
    """The k nearest of (path, embedding); candidates and owner are filtered before the choice."""
    rows = items.where("embedding is not null")
    sizes = [r[0] for r in rows.select(F.size("embedding")).distinct().limit(3).collect()]
    if any(n != len(query) for n in sizes):
        raise ValueError(f"the query has {len(query)} dimensions, the vectors have {sizes}")
    if owner is not None:
        rows = rows.where(F.col("owner_id") == owner)
    if candidates is not None:
        rows = rows.join(candidates.df.select("path"), "path", "left_semi")
    return Relation.by_path(rows.select("path", score(F.col("embedding"), query, metric).alias("score")), "vector_search").top(k)


def embed_column(col: Column, embed_batch: Callable[[list[str]], list[Sequence[float]]]) -> Column:
    """Vectors of a text column, in Arrow batches."""
    ship()

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in v] for v in embed_batch([t or "" for t in texts])])

    return run(col)


def semantic_search(items: DataFrame, query: str, embed: Callable[[str], Sequence[float]], k: int = 15, **options: object) -> Relation:
    if not query.strip():
        raise ValueError("the query is blank")
    from dataclasses import replace

    return replace(vector_search(items, embed(query), k, **options), function="semantic_search")


class VectorStore:
    """A keyed table of vectors: upsert, delete, query."""

    def __init__(self, df: DataFrame):
        self.df = df.select("path", "embedding", *(["owner_id"] if "owner_id" in df.columns else [F.lit(None).cast("string").alias("owner_id")]))

    def upsert(self, rows: DataFrame) -> VectorStore:
        new = VectorStore(rows).df
        return VectorStore(self.df.join(new.select("path"), "path", "left_anti").unionByName(new))

    def delete(self, paths: Iterable[str]) -> VectorStore:
        gone = self.df.sparkSession.createDataFrame([(p,) for p in paths], "path string")
        return VectorStore(self.df.join(gone, "path", "left_anti"))

    def query(self, vector: Sequence[float], k: int = 15, **options: object) -> Relation:
        return vector_search(self.df, vector, k, **options)
