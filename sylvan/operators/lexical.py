"""BM25 over live text rows, from postings of the query's terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.functions import text as X
from sylvan.functions.shipping import ship
from sylvan.operators.relation import Relation
from sylvan.operators.scan import live

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Texts of so many characters, and one more, are counted at once.
GRAM_CHARACTERS = 2_000_000


def corpus(entries: DataFrame, candidates: Relation | None = None) -> DataFrame:
    rows = live(entries).where("kind <> 'version' and content is not null")
    return rows if candidates is None else rows.join(candidates.df.select("path"), "path", "left_semi")


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("lexical_tokens"), F.lit(0)).cast("long").alias("n_tokens"))


def bm25(docs: DataFrame, query: str) -> DataFrame:
    """(path, score) of documents with a term of the query.

    A text that has no term as a substring is never tokenized. The floor of negative
    weights uses the mean over all tokens of the texts that pass, as document frequencies
    within them against the whole corpus size.
    """
    terms = Counter(X.query_terms(query))
    spark = docs.sparkSession
    if not terms:
        return spark.createDataFrame([], "path string, score double")
    low = F.lower("content")
    some = F.lit(False)
    for t in terms:
        some |= low.contains(t)
    passed = docs.where(some).select("path", F.col("lexical_tokens").alias("len"), X.tokens_col(F.col("content")).alias("tokens"))
    stats = corpus_stats(docs).select(F.col("n_docs").cast("double").alias("n"), (F.col("n_tokens") / F.col("n_docs")).alias("avg"))
    per_doc = passed.select("path", "len", F.explode("tokens").alias("term"))
    idf = lambda df: F.log((F.col("n") - df + 0.5) / (df + 0.5))
    df_all = passed.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("df"))
    mean = df_all.crossJoin(F.broadcast(stats)).agg(F.avg(idf(F.col("df"))).alias("mean"))  # one row each
    asked = df_all.where(F.col("term").isin(*terms)).crossJoin(F.broadcast(stats)).withColumn("raw", idf(F.col("df")))  # at most 50 terms
    asked = asked.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(asked.agg(F.avg("raw").alias("own"))))
    # without a positive mean the floor is estimated from the query's own terms, and a weight of zero is floored too
    known = F.col("mean") > 0
    typical = F.when(known, F.col("mean")).when(F.col("own") > 0, F.col("own")).otherwise(F.log(2 * F.col("n") + 1))
    floor = F.greatest(F.lit(0.0), F.lit(EPSILON) * typical)
    boost = F.create_map(*[F.lit(x) for t, k in terms.items() for x in (t, float(k))])
    floored = (F.col("raw") < 0) | (~known & (F.col("raw") == 0))
    weights = asked.select("term", "n", "avg", (F.when(floored, floor).otherwise(F.col("raw")) * boost[F.col("term")]).alias("w"))
    tf = per_doc.where(F.col("term").isin(*terms)).groupBy("path", "len", "term").agg(F.count("*").cast("double").alias("tf"))
    part: Column = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B) + K1 * B * F.col("len") / F.col("avg"))
    return tf.join(F.broadcast(weights), "term").groupBy("path").agg(F.sum(part).alias("score")).where("score > 0")


def lexical_search(entries: DataFrame, query: str, k: int = 15, candidates: Relation | None = None) -> Relation:
    """The k best texts; the wide content joins only after they are chosen."""
    docs = corpus(entries, candidates)
    best = Relation.by_path(bm25(docs.select("path", "content", "lexical_tokens"), query), "lexical_search").top(k)
    wide = F.broadcast(best.df.select("path", "score", "_rank"))  # k rows
    rows = docs.select("path", "kind", "content", "size_bytes", "updated_at").join(wide, "path")
    return Relation.by_path(rows, "lexical_search")


def trigrams(files: DataFrame) -> DataFrame:
    """(gram, n, files): how often each three characters of lower-case texts follow each other, and in how many paths.

    Texts are counted as arrays of characters where they lie; only grams with their counts are shuffled.
    """
    ship()
    texts = files.where("length(content) >= 3").groupBy("path").agg(F.collect_list(F.lower("content")).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, size = [], 0
            for own in batch.column(0):
                some.append([t for t in own.as_py() if len(t) >= 3])
                size += sum(map(len, some[-1]))
                if size >= GRAM_CHARACTERS:
                    yield _count_grams(some)
                    some, size = [], 0
            if size:
                yield _count_grams(some)

    found = texts.select("texts").mapInArrow(run, "gram string, n long, files long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("files").alias("files"))


def _count_grams(texts: list[list[str]]) -> pa.RecordBatch:
    """Of a list for each path. A gram is 63 bits, 21 a character."""
    flat = [t for own in texts for t in own]
    length = np.array([len(t) for t in flat])
    path = np.repeat(np.arange(len(texts)), [len(own) for own in texts])
    c = np.frombuffer("".join(flat).encode("utf-32-le"), np.uint32).astype(np.int64)
    key = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    inner = np.ones(len(c), bool)
    ends = np.cumsum(length)
    inner[ends - 1] = inner[ends - 2] = False
    grams, code = np.unique(key[inner[: len(key)]], return_inverse=True)
    pairs = np.unique(code * len(texts) + np.repeat(path, length - 2))
    names = [chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF) for k in grams.tolist()]
    counts = [np.bincount(x, minlength=len(grams)) for x in (code, pairs // len(texts))]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(x, pa.int64()) for x in counts)], ["gram", "n", "files"])
