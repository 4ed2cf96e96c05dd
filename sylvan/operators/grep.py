"""Line search: lines are exploded once; windows of context are islands over matching lines alone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions import patterns as G
from sylvan.operators.relation import FIELDS, Relation
from sylvan.operators.scan import live, structural


def matching_lines(texts: DataFrame, pattern: str, case: str = "sensitive", fixed: bool = False, word: bool = False, invert: bool = False) -> DataFrame:
    """(path, line_no, line, n_lines) of the lines that match; line numbers begin at 1."""
    regex = G.line_regex(pattern, case, fixed, word)
    rows = texts.where("content is not null and content <> ''")
    loose = case == "insensitive" or case == "smart" and pattern == pattern.lower()
    if not invert and not loose:
        for w in G.literals(pattern, fixed):  # whole texts without a needed literal are never split
            rows = rows.where(F.col("content").contains(w))
    lines = rows.select("path", F.split("content", "\n").alias("all")).select("path", F.size("all").alias("n_lines"), F.posexplode("all").alias("pos", "line"))
    hit = F.regexp_like("line", F.lit(regex))
    return lines.where(~hit if invert else hit).select("path", (F.col("pos") + 1).alias("line_no"), "line", "n_lines")


def windows(hits: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    """(path, start, end, match): matches with their context; windows that touch are one."""
    w = Window.partitionBy("path").orderBy("line_no")
    low, high = F.greatest(F.lit(1), F.col("line_no") - before), F.least(F.col("n_lines"), F.col("line_no") + after)
    spans = hits.select("path", F.col("line_no").alias("match"), low.cast("int").alias("low"), high.cast("int").alias("high"))
    if not before and not after:
        return spans.select("path", F.col("low").alias("start"), F.col("high").alias("end"), "match")
    w = Window.partitionBy("path").orderBy("match")
    begins = spans.withColumn("new", (F.col("low") > F.coalesce(F.lag("high").over(w), F.lit(-1)) + 1).cast("int")).withColumn("island", F.sum("new").over(w))
    own = Window.partitionBy("path", "island")
    return begins.select("path", F.min("low").over(own).alias("start"), F.max("high").over(own).alias("end"), "match")


def grep(entries: DataFrame, pattern: str, paths: Iterable[str] = (), ext: Iterable[str] = (), ext_not: Iterable[str] = (), globs: Iterable[str] = (), globs_not: Iterable[str] = (), case: str = "sensitive", fixed: bool = False, word: bool = False, invert: bool = False, before: int = 0, after: int = 0, output: str = "lines", max_count: int | None = None, candidates: Relation | None = None) -> Relation:
    """One row for each file with a hit; its score is the number of matching lines. ``max_count`` limits files, in path order."""
    rows = live(entries).where("kind = 'file'").where(structural(ext, ext_not, paths, globs, globs_not, keep_unknown=candidates is not None))
    if candidates is not None:
        rows = rows.join(candidates.df.select("path"), "path", "left_semi")
    hits = matching_lines(rows.select("path", "content"), pattern, case, fixed, word, invert)
    if output == "lines":
        found = windows(hits, before, after).groupBy("path").agg(F.count("*").cast("double").alias("score"), F.transform(F.sort_array(F.collect_list(F.struct("match", "start", "end"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["match"].alias("match"))).alias("lines"))
    else:
        found = hits.groupBy("path").agg(F.count("*").cast("double").alias("score"))
    out = Relation.by_path(found.withColumn("kind", F.lit("file")), "grep")
    if candidates is not None:
        lead = candidates.df.select("path", F.col("_side").alias("_s"), F.col("_rank").alias("_r"))
        out = out._with(out.df.drop("_side", "_rank").join(lead, "path").withColumnRenamed("_s", "_side").withColumnRenamed("_r", "_rank").select(*FIELDS, "_side", "_rank"), sides=candidates.sides)
    return out.limit(max_count)
