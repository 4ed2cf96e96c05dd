"""Packing along a space-filling curve.

Each document's vector of hashed trigrams is projected to three dimensions, its place on a
Hilbert curve becomes its key, and documents are range-partitioned by key. Neighbours on
the curve are packed one after another into sequences, cut wherever a sequence is full.
What is left at the end of a range is laid out in sequences of powers of two, which need
no padding, so no position is ever padded.

The range bounds are quantiles, by length, of the keys of a hashed sample (BOUND_ROWS rows a
range); every document is keyed, and packed in its range. A key ends in 20 bits of hash of
id and text, so a group of copies spreads over ranges. Token ids travel once, as
16-bit numbers.

Edge cases: a null or empty text is the end id alone; documents longer than a sequence
run over as many as they need; repeated rows are packed each on its own; ties of the key
are ordered by id, then text hash; an empty table gives an empty table; only the named
columns are read. Null ids stay null.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.common import FIRST_BYTES, arrow_schema, doc_text, documents, kept, prepare, scramble, spans, unusual, utf8
from sylvan.llm.common import lowered as lower_case

END, LENGTH, BITS, TIE, GRAM_BITS, BOUND_ROWS = 2, 4096, 10, 20, 12, 256
U64 = np.uint64
#: Letters whose lower case is one character whatever stands beside it, and that stay as they are in NFC.
LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LETTER = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)])
MARKS = np.array([chr(c) in PUNCTUATION for c in range(256)])
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TokenTable:
    """Ids of units of text, each tokenized once, as 16-bit numbers.

    The tokenizer lower-cases, drops white space and keeps letters and punctuation apart, so
    a text falls into units: what stands between spaces and line feeds, cut again where
    punctuation (but no apostrophe) follows a letter. Units of up to 16 bytes are found by
    a hash and compared byte for byte; longer ones, and texts with other characters than
    ASCII and the Latin letters of two bytes from C3 80 on, are tokenized as they come.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        assert self.tokenizer.get_vocab_size() <= 1 << 16
        self.limit = limit
        # what the short cuts rest on is asked of the tokenizer, not assumed
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        folds = ids("Ab CÉ\nßx" + LATIN.upper()) == ids("ab cé ßx" + LATIN.upper().lower())
        cuts = all(ids("ab" + t + tail) == ids("ab") + ids(t + tail) for t in PUNCTUATION for tail in ("", t, "c", "'s", "1"))
        self.usable = folds and cuts and ids(LATIN) == ids(LATIN + " ") and ids("ab\ncd ef") == ids("ab") + ids("cd") + ids("ef")
        self.clear(limit)

    def clear(self, room: int) -> None:
        self.hash, self.entry = np.empty(0, U64), np.empty(0, np.int32)
        self.low, self.high = np.empty(room, U64), np.empty(room, U64)
        self.size, self.count = np.empty(room, np.uint8), np.empty(room, np.int32)
        self.start = np.empty(room, np.int64)
        self.pool = np.empty(4 * room, "<u2")
        self.used = self.pooled = 0

    def _add(self, h: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: list[list[int]]) -> None:
        if self.used + len(h) > len(self.low):
            self.clear(max(self.limit, len(h)))
        flat = np.fromiter(itertools.chain.from_iterable(ids), "<u2")
        if self.pooled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.pooled], np.empty(len(flat) + len(self.pool) // 2, "<u2")])
        at = slice(self.used, self.used + len(h))
        self.low[at], self.high[at], self.size[at] = low, high, size
        self.count[at] = np.fromiter(map(len, ids), np.int32, len(ids))
        self.start[at] = self.pooled + np.cumsum(self.count[at]) - self.count[at]
        self.pool[self.pooled : self.pooled + len(flat)] = flat
        by = np.argsort(h)
        to = np.searchsorted(self.hash, h[by])
        self.hash = np.insert(self.hash, to, h[by])
        self.entry = np.insert(self.entry, to, self.used + by)
        self.used += len(h)
        self.pooled += len(flat)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 where there is none."""
        if not self.used:
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.entry[at], -1)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def encode_all(self, data: bytes, offsets: np.ndarray) -> list[bytes]:
        """Ids of each of the UTF-8 texts that stand one after another."""
        d = np.frombuffer(data, np.uint8)
        odd = unusual(d, offsets) if self.usable else np.ones(len(offsets) - 1, bool)
        marks = np.flatnonzero((d[:-1] == 0x3C) & (d[1:] == 0x7C))  # special tokens begin so
        odd[np.searchsorted(offsets, marks, "right") - 1] = True
        lowered = lower_case(data)
        ink = (d != 32) & (d != 10)
        first = ink.copy()
        first[1:] &= ~ink[:-1] | LETTER[d[:-1]] & MARKS[d[1:]]
        begins, ends = offsets[:-1][offsets[:-1] < len(d)], offsets[1:][offsets[1:] > 0] - 1
        first[begins] = ink[begins]
        last = ink.copy()
        last[:-1] &= ~ink[1:] | first[1:]
        last[ends] = ink[ends]
        starts = np.flatnonzero(first)
        size = np.flatnonzero(last) + 1 - starts
        bounds = np.searchsorted(starts, offsets)
        keep = ~np.repeat(odd, np.diff(bounds))
        bounds = np.concatenate([[0], np.cumsum(np.where(odd, 0, np.diff(bounds)))])
        starts, size = starts[keep], size[keep]

        eight = np.ndarray((len(d) + 9,), "<u8", lowered, strides=(1,))
        a = eight[starts] & FIRST_BYTES[np.minimum(size, 8)]
        b = eight[starts + np.minimum(size, 8)] & FIRST_BYTES[np.clip(size - 8, 0, 8)]
        h = scramble(scramble(a ^ size.astype(U64) * U64(0x9E3779B97F4A7C15)) * U64(3) + b)
        by = np.argsort(h)
        new = np.concatenate([[True], h[by][1:] != h[by][:-1]]) if len(h) else np.empty(0, bool)
        kind = np.empty(len(h), np.int64)
        kind[by] = np.cumsum(new) - 1
        one = by[new]
        entry = self._find(h[one])
        absent = one[(entry < 0) & (size[one] <= 16)]
        if len(absent):
            units = [lowered[s : s + n].decode() for s, n in zip(starts[absent].tolist(), size[absent].tolist())]
            ids = [e.ids for k in range(0, len(units), 8192) for e in self.tokenizer.encode_batch_fast(units[k : k + 8192], add_special_tokens=False)]
            cleared = self.used + len(absent) > len(self.low)
            self._add(h[absent], a[absent], b[absent], size[absent], ids)
            if cleared:  # the units that were there before are read anew
                return self.encode_all(data, offsets)
            entry = self._find(h[one])
        entry = np.maximum(entry, 0)[kind]
        same = (self.size[entry] == size) & (self.low[entry] == a) & (self.high[entry] == b) & (size <= 16)
        pool, start, count = self.pool[: self.pooled], self.start[entry], self.count[entry].astype(np.int64)
        rest = np.flatnonzero(~same)
        if len(rest):
            units = [lowered[s : s + n].decode() for s, n in zip(starts[rest].tolist(), size[rest].tolist())]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
            count[rest] = [len(x) for x in ids]
            start[rest] = len(pool) + np.cumsum(count[rest]) - count[rest]
            pool = np.concatenate([pool, np.fromiter(itertools.chain.from_iterable(ids), "<u2")])
        total = np.concatenate([[0], np.cumsum(count)])
        flat = pool[spans(start, count)].tobytes()
        cut = (2 * total[bounds]).tolist()
        out = [flat[x:y] for x, y in zip(cut, cut[1:])]
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.whole(data[offsets[k] : offsets[k + 1]].decode())
        return out


@functools.lru_cache(1)
def projection(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, 1, (1 << GRAM_BITS, 3)).astype(np.float32)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points with integer coordinates (Skilling's transform), one row a point."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[:, i] & q) > 0
            t = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[:, n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[:, i] >> b & 1)
    return out


def keys_of(ids: list, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hilbert place of each text's projected vector of hashed byte trigrams, then bits of a hash of id and text; and a hash of each text."""
    x = np.frombuffer(data, np.uint8).astype(np.uint32)
    gram = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(32 - GRAM_BITS) if len(x) > 2 else np.empty(0, np.uint32)
    vectors = np.zeros((len(ids), 1 << GRAM_BITS), np.float32)
    ties, texts = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
    view = memoryview(data)
    for k, (i, a, b) in enumerate(zip(ids, offsets.tolist(), offsets[1:].tolist())):
        if b - a > 2:
            vectors[k] = np.bincount(gram[a : b - 2], minlength=1 << GRAM_BITS)
        h = xxhash.xxh64_intdigest(view[a:b])
        texts[k] = h >> 1
        ties[k] = xxhash.xxh32_intdigest(f"{i} {h:016x}") >> (32 - TIE)
    np.log1p(vectors, out=vectors)
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    points = vectors @ projection() / np.where(norm > 0, norm, 1)[:, None]
    # each coordinate is about normal; the logistic curve spreads it over the cells
    cells = np.clip((1 << BITS) / (1 + np.exp(-1.702 * points)), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells) << TIE | ties, texts


def piece_crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """Lays documents one after another; ``rows`` collects the pieces of full sequences."""

    def __init__(self, first: int, length: int = LENGTH):
        self.sequence, self.length, self.used = first, length, 0
        self.open: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            n = min(total - start, self.length - self.used)
            self.open.append((doc_id, start, ids[start : start + n], total))
            self.used, start = self.used + n, start + n
            if self.used == self.length:
                self._close(self.open)
                self.open, self.used = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), piece_crc(ids), total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def finish(self) -> None:
        """What is left, in sequences of powers of two, the longest first."""
        todo = self.open[::-1]
        left = self.used
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            own = []
            while room:
                doc_id, start, ids, total = todo.pop()
                if len(ids) > room:
                    todo.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                own.append((doc_id, start, ids, total))
                room -= len(ids)
            self._close(own)
        self.open, self.used = [], 0

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[]] * len(schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        self.rows = []
        return out


def range_bounds(docs: DataFrame, n: int) -> np.ndarray:
    """Keys that part documents into n ranges of about equal length, from the keys of those of least hash: about BOUND_ROWS a range.

    They say only where one range ends; every document is keyed and packed.
    """
    if n < 2:
        return np.empty(0, np.int64)
    share = BOUND_ROWS * n / max(1, docs.count())
    own = F.xxhash64("doc_id", "text")
    some = docs if share >= 1 else docs.where(own < F.lit(int((2 * share - 1) * (1 << 63))))
    schema = arrow_schema(T.StructType.fromDDL("key long, size long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            key, _ = keys_of(batch.column(0).to_pylist(), data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.diff(offsets) + 8)], schema=schema)

    found = some.mapInArrow(run, "key long, size long").toArrow()
    key, size = (found.column(k).to_numpy() for k in (0, 1))
    if not len(key):
        return np.empty(0, np.int64)
    by = np.argsort(key, kind="stable")
    total = np.cumsum(size[by])
    return np.unique(key[by][np.minimum(np.searchsorted(total, total[-1] * np.arange(1, n) / n), len(by) - 1)])


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, partitions: int | None = None) -> DataFrame:
    """One row for each piece of a document in a sequence."""
    docs = doc_text(df, id_col, text_col)
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, n)
    row = arrow_schema(T.StructType.fromDDL("bucket int, key long, doc_id long, h long, ids binary"))

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept(__name__, tokenizer_path, lambda: TokenTable(tokenizer_path))
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            key, h = keys_of(batch.column(0).to_pylist(), data, offsets)
            bucket = np.searchsorted(bounds, key, "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key), batch.column(0), pa.array(h), pa.array(table.encode_all(data, offsets), pa.binary())], schema=row)

    tokens = docs.mapInArrow(tokenize, "bucket int, key long, doc_id long, h long, ids binary")
    ranged = tokens.repartitionById(n, "bucket").sortWithinPartitions("bucket", "key", "doc_id", "h").select("bucket", "doc_id", "ids")
    schema = arrow_schema(T.StructType.fromDDL(PIECE))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, end = None, np.array([END], "<u2")
        for batch in batches:
            for bucket, doc_id, ids in zip(*(c.to_pylist() for c in batch.columns)):
                packer = packer or Packer(bucket << 40, length)
                packer.add(doc_id, np.concatenate([np.frombuffer(ids, "<u2"), end]))
            if packer and packer.rows:
                yield packer.take(schema)
        if packer:
            packer.finish()
            yield packer.take(schema)

    return ranged.mapInArrow(lay, PIECE)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())
