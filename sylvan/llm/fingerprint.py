"""Document fingerprints: invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs at line feeds; lines of more than 160 bytes are cut further
after spaces where the bytes before say so, so an insertion moves no other cut. The distinct
paragraph digests fill the cells of a table: each digest is added to three cells as a
count, an exclusive-or of digests and one of check sums. Tables of two versions subtract
cell by cell and peeling recovers the digests that only one of them has. Where peeling
fails, larger tables are built, until it succeeds; at many more cells than digests the sets
are compared outright.

The fingerprint is the smallest table, in hexadecimal, with the number of digests;
likeness is the shared part of both texts' digests (Dice), from their numbers and the recovered
difference.

Edge cases: null and empty texts have no paragraphs, an empty table, and likeness 1 to
each other, 0 to any other text; of repeated ids the rows follow one another by text
hash and text; null ids come last; a single row is its own next document; an empty
table gives an empty table; texts are read whole; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.common import arrow_schema, doc_text, documents, prepare

CELLS, HASHES, LONG_PARAGRAPH, CUT_BITS = 24, 3, 160, 3
CHECK, ROUNDS = 0x5BD1E995, 400
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long, cells_edited long"


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where paragraphs end: at every line feed, and in lines of more than LONG_PARAGRAPH bytes after spaces whose last four bytes hash so."""
    feeds = np.flatnonzero(raw == 10)
    spaces = np.flatnonzero(raw == 32)
    spaces = spaces[spaces >= 4]
    if not len(spaces):
        return feeds
    b = raw.astype(np.uint32)
    h = b[spaces - 1] * np.uint32(0x9E3779B1) ^ b[spaces - 2] * np.uint32(0x85EBCA6B) ^ b[spaces - 3] * np.uint32(0xC2B2AE35) ^ b[spaces - 4] * np.uint32(0x27D4EB2F)
    spaces = spaces[(h >> np.uint32(32 - CUT_BITS)) == 0]
    edges = np.concatenate([[-1], feeds, [len(raw)]])
    line = np.searchsorted(edges, spaces)
    spaces = spaces[edges[line] - edges[line - 1] > LONG_PARAGRAPH]
    return np.sort(np.concatenate([feeds, spaces]))


def paragraphs(text: str) -> list[bytes]:
    """Paragraphs in UTF-8 without outer white space, the long ones cut further."""
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for cut in [*cuts(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]:
        part = raw[at:cut].strip()
        if part:
            out.append(part)
        at = cut
    return out


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit paragraph digests, sorted; a text of white space alone has one of its own."""
    if not text:
        return np.empty(0, np.uint64)
    own = paragraphs(text) or [b"\0" + text.encode("utf-8", "surrogatepass")]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own)))


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Tables:
    """The tables of many digest sets, one behind another, so that numpy builds, subtracts and peels them together.

    Each cell has a count, the exclusive-or of its digests, and that of their check sums;
    a table has three parts, and each digest one cell in each.
    """

    def __init__(self, sets: list[np.ndarray], parts: np.ndarray):
        self.parts = parts
        self.base = np.concatenate([[0], np.cumsum(parts * HASHES)]).astype(np.int64)
        self.count = np.zeros(self.base[-1], np.int32)
        self.keys = np.zeros(self.base[-1], np.uint64)
        self.checks = np.zeros(self.base[-1], np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        if len(owner):
            self._add(np.concatenate(sets), owner, np.ones(len(owner), np.int32))

    def _add(self, keys: np.ndarray, owner: np.ndarray, signs: np.ndarray) -> None:
        check, part, base = mix(keys, CHECK), self.parts[owner], self.base[owner]
        for k in range(HASHES):
            at = base + k * part + (mix(keys, k + 1) % part.astype(np.uint64)).astype(np.int64)
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, check)

    def minus(self, other: Tables) -> Tables:
        out = object.__new__(Tables)
        out.parts, out.base = self.parts, self.base
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and sign of all that peels, and which tables came out empty. Uses the tables up."""
        cell_owner = np.repeat(np.arange(len(self.parts)), self.parts * HASHES)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(ROUNDS):
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[mix(self.keys[pure], CHECK) == self.checks[pure]]
            if not len(pure):
                break
            owner, keys, signs = cell_owner[pure], self.keys[pure], self.count[pure]
            by = np.lexsort((keys, owner))
            owner, keys, signs = owner[by], keys[by], signs[by]
            once = np.concatenate([[True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])])
            owner, keys, signs = owner[once], keys[once], signs[once]
            found.append((owner, keys, signs))
            self._add(keys, owner, -signs)
        left = np.bincount(cell_owner[(self.count != 0) | (self.keys != 0) | (self.checks != 0)], minlength=len(self.parts))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32), left == 0
        return *(np.concatenate(x) for x in zip(*found)), left == 0

    def hex(self, sizes: list[int]) -> list[str]:
        out = []
        for k, n in enumerate(sizes):
            at = slice(self.base[k], self.base[k + 1])
            out.append(f"{n:x}." + self.count[at].astype(">i2").tobytes().hex() + "." + self.keys[at].astype(">u8").tobytes().hex() + "." + self.checks[at].astype(np.uint32).astype(">u4").tobytes().hex())
        return out


def small(sets: list[np.ndarray]) -> Tables:
    return Tables(sets, np.full(len(sets), CELLS // HASHES, np.int64))


def differences(a: list[np.ndarray], b: list[np.ndarray], first: Tables | None = None) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Digests only in a[k], only in b[k], and the cells that it took, for every k.

    ``first`` has the differences of the fingerprints' own tables. Sets whose table fails
    are tried with room for every digest to differ, then with twice the cells, and so on;
    at many more cells than digests they are compared outright.
    """
    out: list = [None] * len(a)
    todo = np.arange(len(a))
    total = np.array([len(x) + len(y) for x, y in zip(a, b)])
    parts = np.full(len(a), CELLS // HASHES, np.int64)
    table = first
    while len(todo):
        if table is None:
            x, y = Tables([a[k] for k in todo], parts[todo]), Tables([b[k] for k in todo], parts[todo])
            table = x.minus(y)
        owner, keys, signs, empty = table.peel()
        bounds = np.searchsorted(owner[by := np.argsort(owner, kind="stable")], np.arange(len(todo) + 1))
        keys, signs = keys[by], signs[by]
        for j in np.flatnonzero(empty).tolist():
            own = slice(bounds[j], bounds[j + 1])
            out[todo[j]] = (keys[own][signs[own] > 0], keys[own][signs[own] < 0], int(parts[todo[j]]) * HASHES)
        todo, table = todo[~empty], None
        parts[todo] = np.maximum(2 * parts[todo], -(-(CELLS + total[todo] * 3 // 2) // HASHES))
        for k in todo[parts[todo] * HASHES > 16 * (total[todo] + CELLS)].tolist():
            out[k] = (np.setdiff1d(a[k], b[k]), np.setdiff1d(b[k], a[k]), int(parts[k]) * HASHES)
        todo = np.array([k for k in todo.tolist() if out[k] is None], np.int64)
    return out


def likeness(a: np.ndarray, b: np.ndarray, only_a: int, only_b: int) -> float:
    both = len(a) - only_a
    every = 2 * both + only_a + only_b
    return 2 * both / every if every else 1.0


def edit(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text; the next document is the one of the next smaller id.

    Rows are range-partitioned by id, and the row that begins a range (its bound, an id
    that occurs) also goes to the range before it, so each text meets its next one and
    every text moves once.
    """
    docs = doc_text(df, id_col, text_col).withColumn("h", F.xxhash64("text")).withColumn("nil", F.col("doc_id").isNull().cast("int"))
    spark = docs.sparkSession
    prepare(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = docs.where("nil = 0").select("doc_id")
    # ids as they occur, at quantiles: bounds of the ranges, and what stands first and last
    picked = known.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] if n > 1 else [0.5], 10_000).alias("q"), F.max("doc_id").alias("top")).first()
    bounds = sorted({*(picked["q"] or []), *([picked["top"]] if picked["top"] is not None else [])}, reverse=True)  # descending, each begins a range
    nulls_only = not bounds
    ranges = max(1, len(bounds))
    table = F.array(*[F.lit(-b if b != -(2**63) else 2**63 - 1).cast("long") for b in bounds]) if bounds else None
    # range k has the ids from its bound down to above the next one; null ids end the last range
    pid = F.lit(0) if nulls_only else F.when(F.col("nil") == 1, ranges - 1).otherwise(F.size(F.filter(table, lambda b: b <= -F.col("doc_id"))) - 1)
    begins = F.lit(False) if nulls_only else F.coalesce(F.array_contains(table, -F.col("doc_id")), F.lit(False))
    own = docs.withColumn("pid", pid.cast("int"))
    halo = F.when(begins, F.array(F.struct(F.col("pid").alias("p"), F.lit(0).alias("halo")), F.struct(((F.col("pid") + ranges - 1) % ranges).alias("p"), F.lit(1).alias("halo")))).otherwise(F.array(F.struct(F.col("pid").alias("p"), F.lit(0).alias("halo"))))
    placed = own.select("doc_id", "text", "h", "nil", F.explode(halo).alias("at")).select(F.col("at.p").alias("p"), F.col("at.halo").alias("halo"), "nil", "doc_id", "h", "text")
    ordered = placed.repartitionById(ranges, "p").sortWithinPartitions("p", "halo", "nil", F.desc("doc_id"), "h", "text").select("halo", "doc_id", "text")
    schema = arrow_schema(T.StructType.fromDDL(FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, first, over = None, None, False
        for batch in batches:
            rows = []
            for halo, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                if over:
                    break
                if waiting is None and halo:
                    break  # a range without rows of its own
                here = (doc_id, text, digests(text))
                if waiting is not None:
                    rows.append((waiting, here))
                first = first or here
                waiting, over = here, bool(halo)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows_of(rows), schema)], schema=schema)
        if waiting is not None and not over:  # no bound at all: the first row follows the last
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows_of([(waiting, first)]), schema)], schema=schema)

    return ordered.mapInArrow(run, FIELDS)


def rows_of(pairs: list[tuple[tuple, tuple]]) -> list[list]:
    """Columns of the result for (document, next document) pairs; a document is (id, text, digests)."""
    own, after = [h[2] for h, _ in pairs], [f[2] for _, f in pairs]
    edited = [edit(h[1], f[1]) for h, f in pairs]
    other = [digests(t) for t in edited]
    own_tables, other_tables, after_tables = small(own), small(other), small(after)
    to_edited = differences(own, other, own_tables.minus(other_tables))
    to_next = differences(own, after, own_tables.minus(after_tables))
    return [
        [h[0] for h, _ in pairs], [len(h[1]) for h, _ in pairs], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], own_tables.hex([len(x) for x in own]), other_tables.hex([len(x) for x in other]),
        [likeness(x, y, len(d[0]), len(d[1])) for x, y, d in zip(own, other, to_edited)], [likeness(x, y, len(d[0]), len(d[1])) for x, y, d in zip(own, after, to_next)], [len(x) for x in own], [d[2] for d in to_edited],
    ]


def op5_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprint_texts(documents(spark, sf_dir))
