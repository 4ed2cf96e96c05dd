"""Shared plumbing of the training-data operators: Arrow mapping, staging in the
shared folder, and a key look-up that survives hot keys."""

from __future__ import annotations

import atexit
import bisect
import ctypes
import itertools
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BATCH_ROWS = 1024
_staged: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, and keep Arrow batches small.

    Batches hold whole documents, so the default of 10,000 rows would be tens of
    megabytes for each of several copies; an explicit setting of the user stays.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where it is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="sylvan-")
        _staged.append((spark, _own[key]))
    return _own[key]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _staged:
        try:
            _delete(spark, path)
        except Exception:  # the session is already gone
            pass


class Staged:
    """A table written to the shared folder: lineage ends here, any executor can reread it."""

    def __init__(self, df: DataFrame, name: str, partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/sylvan/{name}-{uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        _staged.append((self.spark, self.path))

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _staged[:] = [x for x in _staged if x[1] != self.path]


def stage(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
U64 = np.uint64
#: Masks of the first k bytes of a little-endian 64-bit number.
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes their bits."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of the stretches that begin at ``start`` and are ``n`` long."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def utf8(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts of an Arrow column one after another, and where each begins and the last ends; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return b"", np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, wide, len(column) + 1, column.offset * np.dtype(wide).itemsize).astype(np.int64)
    return b"" if data is None else data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes(), offsets - offsets[0]


LONG_WORD = 256


def hash_spans(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes; at least 8 more bytes follow the last one."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = scramble((eight[starts] & FIRST_BYTES[np.minimum(lengths, 8)]) ^ (lengths.astype(U64) * U64(0x9E3779B97F4A7C15)))
    k, left = 8, np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD))
    while len(left):
        h[left] = scramble(h[left] * U64(3) + (eight[starts[left] + k] & FIRST_BYTES[np.minimum(lengths[left] - k, 8)]))
        k += 8
        left = left[lengths[left] > k]
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(bytes(data[starts[i] : starts[i] + lengths[i]]))
    return h


#: Bytes of UTF-8 beside which a text is handled as a string: of all but ASCII and the letters of two bytes from C3 80 on.
OTHER = np.array([c >= 0xC0 and c != 0xC3 for c in range(256)])


def unusual(d: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which of the texts that stand one after another have other characters than ASCII and Latin letters from U+00C0 to U+00FF."""
    odd = np.zeros(len(offsets) - 1, bool)
    strange = OTHER[d]
    strange[1:] |= (d[:-1] == 0xC3) & ((d[1:] == 0x97) | (d[1:] == 0xB7))  # the signs among the letters
    odd[np.searchsorted(offsets, np.flatnonzero(strange), "right") - 1] = True
    return odd


def lowered(data: bytes) -> bytearray:
    """ASCII and Latin letters in lower case, in texts that aren't unusual; 16 bytes follow."""
    out = bytearray(data.translate(LOWER) + bytes(16))
    d, low = np.frombuffer(data, np.uint8), np.frombuffer(out, np.uint8)
    at = np.flatnonzero(d[:-1] == 0xC3) + 1 if len(d) else np.empty(0, np.int64)
    low[at] += np.where(d[at] <= 0x9E, 0x20, 0).astype(np.uint8)
    return out


_kept: dict[tuple, object] = {}


def kept(owner: str, key: object, make: Callable[[], object]) -> object:
    """State that a Python worker keeps between its tasks, of one operator at a time: another's goes when it begins."""
    forget(owner)
    if (owner, key) not in _kept:
        _kept.clear()
        _kept[owner, key] = make()
    return _kept[owner, key]


def forget(owner: str = "") -> None:
    """Drop what other operators kept in this worker, and give freed memory back to the system."""
    if any(k[0] != owner for k in _kept):
        _kept.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def map_columns(df: DataFrame, fn: Callable[..., dict], schema: str | T.StructType, make: Callable[[], object] | None = None) -> DataFrame:
    """Run ``fn(state, *column_lists) -> {column: values}`` over Arrow batches of ``df``.

    ``make`` builds per-task state (a tokenizer, a cache). The columns of ``df`` arrive
    as Python lists in order; output columns are converted to ``schema``.
    """
    prepare(df.sparkSession)
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = arrow_schema(struct)

    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(owner)
        state = make() if make else None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = fn(state, *(c.to_pylist() for c in batch.columns))
            arrays = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, struct)


def doc_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and text under fixed names; extra columns, clashing or not, are left behind."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


class Bloom:
    """A filter of 16 bits a key, 2**26 bits at most; a fuller one merely lets more through."""

    def __init__(self, keys: DataFrame):
        self.width = min(26, max(13, (16 * max(1, keys.count())).bit_length()))
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << width, bool)
            for batch in batches:
                for at in Bloom.places(batch.column(0).to_numpy(), width):
                    bits[at] = True
            words = np.packbits(bits).reshape(-1, 1024)
            used = np.flatnonzero(words.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([words[k].tobytes() for k in used], pa.binary())], names=["block", "bits"])

        def merge(table: pa.Table) -> pa.Table:
            bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()])
            return pa.table({"block": table.column("block")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

        ddl = "block int, bits binary"
        found = keys.mapInArrow(run, ddl).groupBy("block").applyInArrow(merge, ddl).toArrow()
        out = np.zeros((1 << width) // 8, np.uint8).reshape(-1, 1024)
        for block, bits in zip(found.column("block").to_pylist(), found.column("bits").to_pylist()):
            out[block] = np.frombuffer(bits, np.uint8)
        self.bits = out.ravel()

    @staticmethod
    def places(keys: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        x = scramble(keys.astype(np.int64).view(U64))
        return tuple((x >> U64(s) & U64((1 << width) - 1)).astype(np.int64) for s in (0, 19, 38))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self.places(keys, self.width):
            found &= (self.bits[at >> 3] & (128 >> (at & 7))) > 0
        return found


class Taken:
    """Stretches of a text, to ask which of them another one meets."""

    def __init__(self, spans: list[tuple]):
        own = sorted((s[0], s[1]) for s in spans)
        self.starts = [s for s, _ in own]
        self.ends = list(itertools.accumulate((e for _, e in own), max))

    def meets(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.starts, end)
        return k > 0 and self.ends[k - 1] > start


#: What is sent to all tasks at once has at most so many bytes.
BROADCAST_BYTES, SALTS = 32 << 20, 16


def lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", hot_share: float = 0.001, hot_max: int = 10_000, size: Column | None = None) -> DataFrame:
    """Join ``big`` with ``small`` (one row per key) though one key may hold a third of ``big``.

    Keys with at least ``hot_share`` of the rows of ``big`` (at most 1 / hot_share of
    them, so the broadcast is bounded) are joined by broadcast where they lie; all
    other keys shuffle, and none of those is hot. Nothing is dropped or capped:
    keys beyond ``hot_max`` merely take the shuffle. Null keys match nothing.
    ``size`` gives the bytes of a row of ``small`` where rows aren't of a few fixed
    columns: the hottest keys are then sent as far as BROADCAST_BYTES go, and the
    others are joined part by part, a hot key's rows spread over SALTS parts.
    """
    counts = big.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = max(1, big.count())
    hot = counts.where(F.col("_n") >= max(2.0, total * hot_share)).orderBy(F.desc("_n")).limit(min(hot_max, int(1 / hot_share)))
    rows = [tuple(r[k] for k in keys) for r in hot.select(*keys).collect() if all(r[k] is not None for k in keys)]
    if not rows:
        return big.join(small, keys, how)
    fields = T.StructType([T.StructField(k, big.schema[k].dataType, True) for k in keys])
    spark = big.sparkSession
    if size is not None:
        sizes = {tuple(r[k] for k in keys): r["_size"] for r in small.join(F.broadcast(spark.createDataFrame(rows, fields)), keys, "left_semi").select(*keys, size.alias("_size")).collect()}
        total, fit = 0, []
        for row in rows:  # the hottest first
            total += sizes.get(row, 0)
            if total <= BROADCAST_BYTES:
                fit.append(row)
        wide = [r for r in rows if r not in set(fit)]
        if wide:
            wide_keys = F.broadcast(spark.createDataFrame(wide, fields))
            salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
            spread = big.join(wide_keys, keys, "left_semi").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
            some = spread.join(small.join(wide_keys, keys, "left_semi").select("*", salt), [*keys, "_salt"], how).drop("_salt")
            others = lookup(big.join(wide_keys, keys, "left_anti"), small.join(wide_keys, keys, "left_anti"), keys, how, hot_share, hot_max, size)
            return some.unionByName(others)
    hot_keys = F.broadcast(spark.createDataFrame(rows, fields))
    marked = big.join(hot_keys.withColumn("_hot", F.lit(True)), keys, "left")
    hot_small = F.broadcast(small.join(hot_keys, keys, "left_semi"))
    warm = marked.where(F.col("_hot").isNotNull()).drop("_hot").join(hot_small, keys, how)
    cold = marked.where(F.col("_hot").isNull()).drop("_hot").join(small.join(hot_keys, keys, "left_anti"), keys, how)
    return warm.unionByName(cold)
