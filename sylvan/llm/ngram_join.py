"""Near duplicates by an exact n-gram Jaccard join over a token-group matrix.

Each document's set has its distinct 3-word shingles as 64-bit hashes; two documents link
when 100 * |intersection| >= 70 * |union|.

1. Classes. Equal sets are one class, known by a hash of the set; only classes are compared.
2. Screen. Every task sends its shingles once to parts of the hash space, which tell how
   many of a class's shingles other classes (or other tasks) have too. A class of which
   fewer than 0.7 of the shingles repeat links with nothing and goes no further.
3. Order. The remaining classes' shingles are counted the same way; rare ones come first.
   Two linked sets share a shingle among the first n - ceil(0.7 n) + 1 of each.
4. Candidates. First shingles meet by hash; bounds on size and position decide who may link.
   What comes out is not pairs but, for each part of the hash space, a spanning forest.
5. Matrix. What hangs together lies in one task: similar classes (those whose frequent
   shingles have the same least hash) stand together in groups of BLOCK, each with the union
   of its shingles. One sparse product bounds the overlap of every class with every union,
   and only groups that may hold a link are opened: their exact intersections are one dense
   product.
6. Connected candidates of more than TOGETHER_CLASSES classes or TOGETHER_TOKENS shingles
   don't lie together: there each class visits the groups that hold a candidate of its own,
   and large groups are split into blocks of which each is opened in a task of its own.

Nothing is dropped or capped at any step; residues of 32 bits are used only where a clash
merely lets more through. Chunks, groups and tasks have a bounded size.

Edge cases: null, empty and white-space texts have no shingles, no links and are their own
component; with one or two words the whole sequence is the one shingle; repeated rows are
documents of their own (they count as copies); null ids count as documents and take part
in links, but a component's id is its smallest id that isn't null; texts are read whole;
an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.common import LOWER, Bloom, Staged, arrow_schema, documents, forget, hash_spans, lookup, map_columns, prepare, scramble, spans, utf8

INK = bytes(int(c != 32 and not 9 <= c <= 13) for c in range(256))
U64, LOW32 = np.uint64, np.uint64(0xFFFFFFFF)
PERCENT = 70
#: A chunk is what a task sends at once; its documents are numbered in 16 bits.
CHUNK_TOKENS, CHUNK_DOCS = 1_000_000, 60_000
#: Input bytes for each part of the hash space, and the most parts.
PART_BYTES, PARTS_MOST = 8 << 20, 1 << 16
BLOCK, LONG_RUN = 128, 64
TOGETHER_CLASSES, TOGETHER_TOKENS = 8192, 4_000_000
#: So many edges are joined up on the driver (16 bytes each), more of them by rounds of stars.
FEW_EDGES = 1_000_000


def need(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
    """Least intersection of linked sets of these sizes: 100 i >= 70 (n + m - i)."""
    return -(-(PERCENT * (n + m)) // (100 + PERCENT))


def least_shared(n: np.ndarray | int) -> np.ndarray | int:
    """Least intersection of a set of this size with any set that it links with."""
    return -(-PERCENT * n // 100)


def word_hashes(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that stand one after another, and the number of each text's words."""
    size = len(data)
    data = data.translate(LOWER) + bytes(8)
    ink = np.frombuffer(data.translate(INK), np.uint8)[:size].view(bool)
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    at = offsets[:-1][offsets[:-1] < size]
    first[at] = ink[at]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = ink[at]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    h = hash_spans(data, starts, lengths)
    return h, np.diff(np.searchsorted(starts, offsets))


def shingle_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, one text after another; and their numbers."""
    w, count = word_hashes(*utf8(column))
    size = np.where(count >= 3, count - 2, np.minimum(count, 1))
    out = np.empty(int(size.sum()), U64)
    ends = np.cumsum(count)
    if len(w) >= 3:
        valid = np.ones(len(w) - 2, bool)
        for back in (1, 2):
            at = ends - back
            valid[at[(at >= 0) & (at < len(valid))]] = False
        out[np.repeat(count >= 3, size)] = scramble(scramble(scramble(w[:-2]) * U64(3) + w[1:-1]) * U64(5) + w[2:])[valid]
    few = np.flatnonzero((count == 1) | (count == 2))
    if len(few):
        h = scramble(w[ends[few] - count[few]] + count[few].astype(U64))
        h = np.where(count[few] == 1, h, scramble(h * U64(3) + w[ends[few] - 1]))
        out[np.repeat(count < 3, size)] = h
    stop = np.cumsum(size)
    start = stop - size
    for a, b in zip(start.tolist(), stop.tolist()):
        if b - a > 1:
            out[a:b].sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    keep[start[size > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[stop] - total[start]


def shingles(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return shingle_batch(pa.array([text.encode("utf-8", "surrogatepass")], pa.binary()))[0]


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def split(tokens: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    return np.split(tokens, np.cumsum(n)[:-1]) if len(n) else []


def part_of(tokens: np.ndarray, parts: int) -> np.ndarray:
    return ((tokens >> U64(32)) * U64(parts) >> U64(32)).astype(np.uint16)


def by_part(tokens: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens ordered by part of the hash space, and where each part begins."""
    own = part_of(tokens, parts)
    by = np.argsort(own, kind="stable")
    return by, np.searchsorted(own[by], np.arange(parts + 1))


def rows_of(schema: pa.Schema, *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows with the same first column, which stand together; (its value, the other columns)."""
    key, held = None, []
    for batch in batches:
        for k, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(rest)
    if held:
        yield key, held


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal values stand together, and the length of the run that each place of it lies in."""
    by = np.argsort(values)
    s = values[by]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(s)))
    return by, np.repeat(lengths, lengths)


# ---- the screen: how many shingles of a class others have too

META = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("fresh", pa.int32()), ("known", pa.int64())])
SENT = "part int, chunk long, kind int, blob binary"


def send(docs: DataFrame, parts: int) -> DataFrame:
    """(part, chunk, kind 0, what is known of each document) and (part, chunk, kind 1, shingles).

    A shingle that several classes of a chunk have is known to repeat and sent once without
    a document, so one that most documents have travels once a chunk.
    """
    schema = arrow_schema(T.StructType.fromDDL(SENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        seen: set[int] = set()
        base, chunk = TaskContext.get().partitionId() << 32, 0
        metas: list[tuple] = []
        held: list[np.ndarray] = []
        owners: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            n = np.array([len(h) for h in held], np.int64)
            tokens = np.concatenate(held) if held else np.empty(0, U64)
            owner = np.repeat(np.array(owners, np.uint16), n)
            by, lengths = runs_of(tokens)
            often = np.empty(len(tokens), bool)
            often[by] = lengths > 1
            known = np.bincount(owner[often], minlength=len(metas))
            told = np.unique(tokens[often])
            tokens, owner = tokens[~often], owner[~often]
            by, cuts = by_part(tokens, parts)
            _, told_cuts = by_part(told, parts)
            fresh = np.full(len(metas), -1, np.int32)
            fresh[owners] = np.arange(len(owners))
            doc_id, row, count, cid = zip(*metas)
            meta = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((doc_id, row, count, cid, fresh, known), META)], schema=META)
            out = [(chunk % parts, base + chunk, 0, meta.serialize().to_pybytes())]
            for p in np.flatnonzero(np.diff(cuts) + np.diff(told_cuts)).tolist():
                at, more = by[cuts[p] : cuts[p + 1]], told[told_cuts[p] : told_cuts[p + 1]]
                step = np.diff(owner[at].astype(np.int64), prepend=0).astype(np.uint16)
                out.append((p, base + chunk, 1, np.array([len(at), len(more)], np.uint32).tobytes() + tokens[at].astype(np.uint32).tobytes() + more.astype(np.uint32).tobytes() + step.astype(np.uint8).tobytes() + (step >> 8).astype(np.uint8).tobytes()))
            return rows_of(schema, *zip(*out))

        for batch in batches:
            tokens, n = shingle_batch(batch.column(1))
            for doc_id, row, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), split(tokens, n)):
                c = class_of(s) if len(s) else None
                metas.append((doc_id, row, len(s), c))
                if c is not None and c not in seen:
                    seen.add(c)
                    held.append(s)
                    owners.append(len(metas) - 1)
                    size += len(s)
                if size > CHUNK_TOKENS or len(metas) >= CHUNK_DOCS:
                    yield flush()
                    metas, held, owners, size, chunk = [], [], [], 0, chunk + 1
        if metas:
            yield flush()

    return docs.mapInArrow(run, SENT)


def answer(sent: DataFrame) -> DataFrame:
    """(chunk, kind 0, as it came) and (chunk, kind 1, number of each document's shingles that repeat in this part)."""
    ddl = "chunk long, kind int, blob binary"
    schema = arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        for _, rows in grouped(batches):
            passed = [r for r in rows if r[1] == 0]
            if passed:
                yield rows_of(schema, *zip(*passed))
            rows = [r for r in rows if r[1] == 1]
            if not rows:
                continue
            sizes = [np.frombuffer(r[2], np.uint32, 2).tolist() for r in rows]
            mine = [np.frombuffer(r[2], np.uint32, k, 8) for r, (k, _) in zip(rows, sizes)]
            told = [np.frombuffer(r[2], np.uint32, m, 8 + 4 * k) for r, (k, m) in zip(rows, sizes)]
            by, lengths = runs_of(np.concatenate([*mine, *told, *told]))
            often = np.empty(len(by), bool)
            often[by] = lengths > 1
            out, before = [], 0
            for (chunk, _, blob), (k, m) in zip(rows, sizes):
                low, high = np.frombuffer(blob, np.uint8, 2 * k, 8 + 4 * (k + m)).astype(np.int64).reshape(2, k)
                count = np.bincount(np.cumsum(low | high << 8)[often[before : before + k]])
                own = np.flatnonzero(count)
                before += k
                if len(own):
                    out.append((chunk, 1, np.array([len(own)], np.uint32).tobytes() + own.astype(np.uint16).tobytes() + count[own].astype(np.uint32).tobytes()))
            if out:
                yield rows_of(schema, *zip(*out))

    return sent.mapInArrow(run, ddl)


def judge(answers: DataFrame) -> DataFrame:
    """(doc_id, row, n, cid, alive) of every document: whether so many of its shingles repeat that it may link."""
    ddl = "doc_id long, row long, n long, cid long, alive int"
    schema = arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        for _, rows in grouped(batches):
            meta = next(pa.ipc.read_record_batch(pa.py_buffer(blob), META) for kind, blob in rows if kind == 0)
            known = meta.column("known").to_numpy().copy()
            for kind, blob in rows:
                if kind == 1:
                    k = int(np.frombuffer(blob, np.uint32, 1)[0])
                    known[np.frombuffer(blob, np.uint16, k, 4)] += np.frombuffer(blob[4 + 2 * k :], np.uint32)
            n = meta.column("n").to_numpy()
            alive = (n > 0) & (meta.column("fresh").to_numpy() >= 0) & (known >= least_shared(n))
            yield pa.RecordBatch.from_arrays([meta.column("doc_id"), meta.column("row"), meta.column("n"), meta.column("cid"), pa.array(alive.astype(np.int32))], schema=schema)

    return answers.mapInArrow(run, ddl)


# ---- sets of the classes that remain, counted and ordered


def sets_of(docs: DataFrame, wanted) -> DataFrame:
    """(cid, tokens) of the documents whose row key the filter may hold, each class once a task."""
    ddl = "cid long, tokens binary"
    schema = arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(1).filter(pa.array(wanted.value.has(batch.column(2).to_numpy())))
            out = {}
            for s in split(*shingle_batch(texts)):
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    out[c] = s.tobytes()
            if out:
                yield rows_of(schema, list(out), list(out.values()))

    return docs.mapInArrow(run, ddl)


def chunks_of(sets: DataFrame, parts: int) -> DataFrame:
    """(part -1, chunk, kind 0, classes with their sets) and (part, chunk, kind 1, shingles in the chunk's order); classes come sorted, repeated ones go."""
    schema = arrow_schema(T.StructType.fromDDL(SENT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        base, chunk, last = TaskContext.get().partitionId() << 32, 0, None
        cids: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            by, cuts = by_part(tokens, parts)
            out = [(-1, base + chunk, 0, pack_sets(cids, held))]
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                out.append((p, base + chunk, 1, tokens[by[cuts[p] : cuts[p + 1]]].astype(np.uint32).tobytes()))
            return rows_of(schema, *zip(*out))

        for batch in batches:
            for c, blob in zip(*(x.to_pylist() for x in batch.columns)):
                if c == last:
                    continue
                last = c
                cids.append(c)
                held.append(np.frombuffer(blob, U64))
                size += len(held[-1])
                if size > CHUNK_TOKENS or len(cids) >= CHUNK_DOCS:
                    yield flush()
                    cids, held, size, chunk = [], [], 0, chunk + 1
        if cids:
            yield flush()

    return sets.mapInArrow(run, SENT)


def pack_sets(cids: list[int], sets: list[np.ndarray]) -> bytes:
    return np.array([len(cids)], np.int64).tobytes() + np.array(cids, np.int64).tobytes() + np.array([len(s) for s in sets], np.int64).tobytes() + b"".join(s.tobytes() for s in sets)


def unpack_sets(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, their sizes, and their shingles one set after another."""
    k = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.int64, k, 8), np.frombuffer(blob, np.int64, k, 8 + 8 * k), np.frombuffer(blob, U64, -1, 8 + 16 * k)


def count(sent: DataFrame) -> DataFrame:
    """(chunk, part, for each shingle as sent the number of classes that have it, 255 at most)."""
    ddl = "chunk long, part int, blob binary"
    schema = arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        for part, rows in grouped(batches):
            values = [np.frombuffer(blob, np.uint32) for _, blob in rows]
            by, lengths = runs_of(np.concatenate(values))
            counts = np.empty(len(by), np.uint8)
            counts[by] = np.minimum(lengths, 255)
            yield rows_of(schema, [r[0] for r in rows], [part] * len(rows), [x.tobytes() for x in np.split(counts, np.cumsum([len(v) for v in values])[:-1])])

    return sent.mapInArrow(run, ddl)


def first_shingles(told: DataFrame, parts: int) -> DataFrame:
    """(part, the first shingles of a chunk's classes in the order of rarity, with the groups of the classes)."""
    ddl = "part int, blob binary"
    schema = arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        for _, rows in grouped(batches):
            cid, n, tokens = unpack_sets(next(blob for part, blob in rows if part < 0))
            by, cuts = by_part(tokens, parts)
            often = np.zeros(len(tokens), np.uint8)
            for part, blob in rows:
                if part >= 0:
                    often[by[cuts[part] : cuts[part + 1]]] = np.frombuffer(blob, np.uint8)
            owner = np.repeat(np.arange(len(n)), n)
            start = np.cumsum(n) - n
            alive = np.bincount(owner, often > 1, len(n)) >= least_shared(n)
            group = groups_of(tokens, owner, start, often)
            by = np.argsort(owner << 8 | often, kind="stable")  # the owners stay in their order
            rank = np.arange(len(by)) - start[owner]
            at = (rank <= (n - least_shared(n))[owner]) & (often[by] > 1) & alive[owner]
            t, o, r = tokens[by[at]], owner[at], rank[at]
            by, cuts = by_part(t, parts)
            out = []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                at = by[cuts[p] : cuts[p + 1]]
                own, local = np.unique(o[at], return_inverse=True)
                out.append((p, np.array([len(own), len(at)], np.uint32).tobytes() + cid[own].tobytes() + group[own].tobytes() + n[own].astype(np.uint32).tobytes() + t[at].astype(np.uint32).tobytes() + np.minimum(r[at], 65535).astype(np.uint16).tobytes() + local.astype(np.uint16).tobytes()))
            if out:
                yield rows_of(schema, *zip(*out))

    return told.mapInArrow(run, ddl)


def groups_of(tokens: np.ndarray, owner: np.ndarray, start: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A class's group: the least of its shingles that are at least half as frequent as its most frequent one."""
    most = np.maximum.reduceat(often, start)
    at = np.flatnonzero(2 * often.astype(np.int64) >= most[owner])
    return tokens[at[np.searchsorted(owner[at], np.arange(len(start)))]]


# ---- candidates


def roots_of(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of so many nodes is connected with by the edges (a, b)."""
    up = np.arange(size)
    while len(a):
        x, y = up[a], up[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, up[up]):
            up = up[up]
    return up


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Shingle, document and position of every entry; class, group and size of every document."""
    entries: list[list[np.ndarray]] = [[], [], []]
    docs: list[list[np.ndarray]] = [[], [], []]
    before = 0
    for b in blobs:
        d, k = np.frombuffer(b, np.uint32, 2).tolist()
        at = 8
        for held, kind, size in zip([*docs, entries[0], entries[2], entries[1]], (np.int64, U64, np.uint32, np.uint32, np.uint16, np.uint16), (d, d, d, k, k, k)):
            held.append(np.frombuffer(b, kind, size, at))
            at += held[-1].nbytes
        entries[1][-1] = entries[1][-1].astype(np.int64) + before
        before += d
    return *(np.concatenate(p) for p in entries), *(np.concatenate(p) for p in docs)


def may_link(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b that share a shingle with so many of their own from it on may link."""
    return (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)) & (np.minimum(left, right) >= need(a, b))


def meetings(token: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, short: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents (x, y) that share a first shingle and may link; where many share one, neighbours by size (with ``short`` all of them)."""
    by = np.argsort(token)
    token, doc, pos = token[by], doc[by], pos[by].astype(np.int64)
    n = n.astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    lengths = np.diff(np.append(starts, len(token)))
    size = n[doc]
    left = size - pos

    def test(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ok = may_link(size[i], size[j], left[i], left[j])
        return doc[i[ok]], doc[j[ok]]

    for length in np.unique(lengths[lengths > 1]).tolist():
        runs = starts[lengths == length]
        if length <= LONG_RUN:
            i, j = np.triu_indices(length, 1)
            step = max(1, 500_000 // len(i))
            for k in range(0, len(runs), step):
                at = runs[k : k + step, None]
                yield test((at + i).ravel(), (at + j).ravel())
            continue
        for start in runs.tolist():
            own = start + np.argsort(size[start : start + length], kind="stable")
            s = size[own]
            if not short:
                # sets between two that may link in size are also near each other in size
                near = PERCENT * s[1:] <= 100 * s[:-1]
                yield doc[own[:-1][near]], doc[own[1:][near]]
                continue
            last = np.searchsorted(s, s * 100 // PERCENT, "right")
            k = 0
            while k < length:
                rows = max(1, 500_000 // max(1, int(last[k]) - k))
                i = np.arange(k, min(length, k + rows))
                many = last[i] - i - 1
                x = np.repeat(i, many)
                y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
                yield test(own[x], own[y])
                k += rows


def forests(packed: DataFrame) -> DataFrame:
    """(a, b): classes and the smallest one that each is connected with, by candidates of a part of the hash space."""
    schema = arrow_schema(T.StructType.fromDDL("a long, b long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        for _, rows in grouped(batches):
            token, doc, pos, cid, _, n = unpack([blob for (blob,) in rows])
            own, doc_of = np.unique(cid, return_inverse=True)
            up, held, size = np.arange(len(own)), [], 0
            for x, y in itertools.chain(meetings(token, doc, pos, n), [(None, None)]):
                if x is not None:
                    held.append((doc_of[x], doc_of[y]))
                    size += len(x)
                if size > 500_000 or x is None:
                    x, y = (np.concatenate(v) for v in zip((np.arange(len(own)), up), *held))
                    up, held, size = roots_of(len(own), x, y), [], 0
            at = np.flatnonzero(up != np.arange(len(own)))
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[up[at]])], schema=schema)

    return packed.mapInArrow(run, "a long, b long")


def visits(packed: DataFrame, wanted) -> DataFrame:
    """(cid, grp): a class and another group, of smaller key, that has a candidate of its own; only classes that the filter may hold."""
    schema = arrow_schema(T.StructType.fromDDL("cid long, grp long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        for _, rows in grouped(batches):
            token, doc, pos, cid, group, n = unpack([blob for (blob,) in rows])
            at = wanted.value.has(cid)[doc]
            held = np.empty((2, 0), np.int64)
            for x, y in meetings(token[at], doc[at], pos[at], n, True):
                x, y = np.where(group[x] > group[y], x, y), np.where(group[x] > group[y], y, x)
                ok = group[x] != group[y]
                held = np.unique(np.concatenate([held, [cid[x[ok]], group[y[ok]].view(np.int64)]], axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], schema=schema)

    return packed.mapInArrow(run, "cid long, grp long")


# ---- exact links


def match(tokens: np.ndarray, n: np.ndarray, weight: np.ndarray, left: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Documents linked with each class, and the smallest class that each is connected with.

    The first ``left`` classes are the members of the matrix; the others visit. With
    ``own`` members are compared with each other too; visitors never are.
    """
    size = len(n)
    add, up = np.zeros(size, np.int64), np.arange(size)
    owner = np.repeat(np.arange(size), n)
    by = np.argsort(tokens, kind="stable")
    new = np.concatenate([[True], tokens[by][1:] != tokens[by][:-1]])
    column = np.empty(len(tokens), np.int64)
    column[by] = np.cumsum(new) - 1
    often = np.bincount(column)[column]
    blocks = -(-left // BLOCK)
    block_of = np.full(size, blocks)
    if blocks > 1:
        key = groups_of(tokens, owner, np.cumsum(n) - n, np.minimum(often, 255).astype(np.uint8))[:left]
        block_of[np.lexsort((n[:left], key))] = np.arange(left) // BLOCK
    else:
        block_of[:left] = 0
    # a shingle of one class is in no intersection
    owner, column = owner[often > 1], column[often > 1]
    column = np.unique(column, return_inverse=True)[1]
    width = int(column.max()) + 1 if len(column) else 0
    length = np.bincount(owner, minlength=size)
    start = np.cumsum(length) - length
    low = np.full(blocks, np.iinfo(np.int64).max)
    high = np.zeros(blocks, np.int64)
    np.minimum.at(low, block_of[:left], n[:left])
    np.maximum.at(high, block_of[:left], n[:left])
    # the matrix: the groups whose unions hold each column, and so each class's overlap with each union
    inside = owner < left
    cells = np.unique(column[inside] * blocks + block_of[owner[inside]])
    first = np.searchsorted(cells, np.arange(width + 1) * blocks)
    many = np.diff(first)[column]
    overlap = np.zeros(size * blocks, np.int64)
    cuts = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + 2_000_000, 2_000_000), "right")
    for a, b in zip(cuts, [*cuts[1:], len(column)]):
        if a < b:
            at = cells[spans(first[column[a:b]], many[a:b])] % blocks
            overlap += np.bincount(np.repeat(owner[a:b], many[a:b]) * blocks + at, minlength=size * blocks)
    overlap = overlap.reshape(size, blocks)
    opens = (np.arange(blocks) < block_of[:, None]) & (PERCENT * n[:, None] <= 100 * high) & (PERCENT * low <= 100 * n[:, None]) & (overlap >= need(n[:, None], np.maximum(low, least_shared(n)[:, None])))
    opens[:left] &= own
    for b in range(blocks):
        members, guests = np.flatnonzero(block_of == b), np.flatnonzero(opens[:, b])
        if not len(guests) and not (own and len(members) > 1):
            continue
        every, m = np.concatenate([members, guests]), len(members)
        col = column[spans(start[every], length[every])]
        row = np.repeat(np.arange(len(every)), length[every])
        union = np.zeros(width, bool)
        union[col[row < m]] = True
        row, col = row[union[col]], (np.cumsum(union) - 1)[col[union[col]]]
        by = np.argsort(col, kind="stable")
        row, col = row[by], col[by]
        got = np.zeros((len(every), m), np.float32)
        step = max(256, 4_000_000 // len(every))
        edges = np.arange(0, int(union.sum()) + step, step)
        at = np.searchsorted(col, edges)
        for k, (x, y) in enumerate(zip(at, at[1:])):
            part = np.zeros((len(every), min(step, int(union.sum()) - k * step)), np.float32)
            part[row[x:y], col[x:y] - k * step] = 1
            got += part @ part[:m].T
        got = np.rint(got).astype(np.int64)
        linked = 100 * got >= PERCENT * (n[every][:, None] + n[members] - got)
        linked[:m] &= own
        linked[np.arange(m), np.arange(m)] = False
        w = linked.astype(np.float64)
        add[every] += np.rint(w @ weight[members]).astype(np.int64)
        add[members] += np.rint(w[m:].T @ weight[guests]).astype(np.int64)
        x, y = np.nonzero(linked)
        up = roots_of(size, np.concatenate([np.arange(size), every[x]]), np.concatenate([up, members[y]]))
    return add, up


def settle(placed: DataFrame) -> DataFrame:
    """(cid, links, component_id) of the linked ones of classes that lie together by root."""
    ddl = "cid long, links long, component_id long"
    schema = arrow_schema(T.StructType.fromDDL(ddl))
    never = np.iinfo(np.int64).max

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        out: list[tuple] = []
        for _, rows in grouped(batches):
            cid, weight, least, blobs = zip(*rows)
            sets = [np.frombuffer(b, U64) for b in blobs]
            add, up = match(np.concatenate(sets), np.array([len(s) for s in sets]), np.array(weight), len(sets), True)
            lowest = np.full(len(sets), never)
            np.minimum.at(lowest, up, np.array([never if x is None else x for x in least]))
            for k in np.flatnonzero(add).tolist():
                x = int(lowest[up[k]])
                out.append((cid[k], int(add[k]), None if x == never else x))
            if len(out) > 20_000:
                yield rows_of(schema, *zip(*out))
                out = []
        if out:
            yield rows_of(schema, *zip(*out))

    return placed.mapInArrow(run, ddl)


def open_blocks(placed: DataFrame) -> DataFrame:
    """(kind 0, cid, number of linked documents) and (kind 1, cid, other cid of a spanning forest) of blocks with their visitors."""
    ddl = "kind int, cid long, value long"
    schema = arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        key, members, guests, size = None, [], [], 0

        def open_(own: bool) -> Iterator[pa.RecordBatch]:
            if members and (own or guests):
                cid, weight, sets = zip(*members, *guests)
                add, up = match(np.concatenate(sets), np.array([len(s) for s in sets]), np.array(weight), len(members), own)
                at, to = np.flatnonzero(add).tolist(), np.flatnonzero(up != np.arange(len(up))).tolist()
                yield rows_of(schema, [0] * len(at) + [1] * len(to), [cid[k] for k in at + to], [int(add[k]) for k in at] + [cid[up[k]] for k in to])

        for batch in batches:
            for grp, sub, part, cid, weight, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if key is not None and (grp, sub, part) != key:
                    yield from open_(key[2] == 0)
                    guests, size = [], 0
                    if (grp, sub) != key[:2]:
                        members = []
                key = grp, sub, part
                s = np.frombuffer(blob, U64)
                (guests if part else members).append((cid, weight, s))
                size += len(s) * part
                if size > CHUNK_TOKENS or len(guests) >= 16 * BLOCK:
                    yield from open_(False)
                    guests, size = [], 0
        if key is not None:
            yield from open_(key[2] == 0)

    return placed.mapInArrow(run, ddl)


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(cid, root) of every node of the edges (a, b): up to ``few`` edges joined at once, more by alternating large and small stars until nothing changes."""
    spark = edges.sparkSession
    table = Staged(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if table.df.count() <= few:
        found = table.df.toArrow()
        ids, at = np.unique(np.concatenate([found.column(k).to_numpy() for k in (0, 1)]), return_inverse=True)
        up = roots_of(len(ids), at[: len(found)], at[len(found) :])
        roots = pa.table({"cid": pa.array(ids, pa.int64()), "root": pa.array(ids[up], pa.int64())})
        table.drop()
        return Staged(spark.createDataFrame(roots, T.StructType.fromDDL("cid long, root long")), "roots").df
    state = None
    while True:
        both = table.df.unionByName(table.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        following = Staged(small, "stars")
        table.drop()
        table = following
        now = table.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = table.df.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("cid"), "root")
    return roots.unionByName(table.df.select(F.col("v").alias("cid"), F.col("v").alias("root")).distinct())


def members_of(packed: DataFrame, wanted) -> DataFrame:
    """(cid, grp) of the classes that the filter may hold."""

    def run(_: object, blobs: list) -> dict:
        found = [unpack([b])[3:5] for b in blobs]
        cid, group = (np.concatenate(x) for x in zip(*found))
        at = wanted.value.has(cid)
        return {"cid": cid[at].tolist(), "grp": group[at].view(np.int64).tolist()}

    return map_columns(packed, run, "cid long, grp long").distinct()


def visited(far: DataFrame, packed: DataFrame, sets: DataFrame, parts: int, block: int) -> DataFrame:
    """(cid, links, component_id) of classes (cid, weight, least) too many to lie together."""
    spark = far.sparkSession
    wanted = spark.sparkContext.broadcast(Bloom(far.select("cid")))
    homes = Staged(far.join(members_of(packed.select("blob"), wanted), "cid").select("cid", "grp"), "homes").df
    info = homes.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sub = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    own = Staged(lookup(homes, info, ["grp"]).select("cid", "grp", sub.alias("home")), "homes").df
    met = visits(packed, wanted).distinct().join(far.select("cid"), "cid", "left_semi")
    before = F.transform(F.sequence(F.lit(0), F.col("home") - 1), lambda k: F.struct(F.col("grp"), k.alias("sub"), F.lit(1).alias("part")))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("grp"), k.alias("sub"), F.lit(1).alias("part")))
    targets = (
        own.select("cid", F.struct("grp", F.col("home").alias("sub"), F.lit(0).alias("part")).alias("t"))
        .unionByName(own.where("home > 0").select("cid", F.explode(before).alias("t")))
        .unionByName(lookup(met, info, ["grp"]).select("cid", F.explode(every).alias("t")))
    )
    placed = targets.join(far.select("cid", "weight"), "cid").join(sets, "cid").select("t.grp", "t.sub", "t.part", "cid", "weight", "tokens")
    found = Staged(open_blocks(placed.repartition(parts, "grp", "sub").sortWithinPartitions("grp", "sub", "part", "cid")), "links").df
    links = found.where("kind = 0").groupBy("cid").agg(F.sum("value").alias("links"))
    roots = components(found.where("kind = 1").select(F.col("cid").alias("a"), F.col("value").alias("b")))
    labelled = Staged(links.join(roots, "cid").join(far.select("cid", "least"), "cid"), "labelled").df
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return lookup(labelled, least, ["root"]).select("cid", "links", "component_id")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", together: tuple[int, int] = (TOGETHER_CLASSES, TOGETHER_TOKENS), block: int = 8 * BLOCK) -> DataFrame:
    """doc_id, n_shingles, n_similar, component_id, class_id (a hash of the set) and row (a hash of id and text) of every document.

    Connected candidates of more than ``together`` (classes, shingles) meet in blocks of about ``block`` classes.
    """
    spark = df.sparkSession
    prepare(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), row_key(df, id_col, text_col).alias("row"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # 2**60 and more: unknown
    parts = min(PARTS_MOST, max(tasks, size // PART_BYTES if size < 1 << 60 else 0))
    tasks = min(tasks, parts)
    at_part = (F.col("part") * F.lit(tasks) / F.lit(parts)).cast("int")

    answers = answer(send(docs, parts).repartitionById(tasks, at_part).sortWithinPartitions("part"))
    told = Staged(judge(answers.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind")), "sets")
    meta = told.df
    grouped_ = meta.where("n > 0").groupBy("cid")
    classes = Staged(grouped_.agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.max("alive").alias("alive"), F.min("row").alias("row")), "classes").df

    wanted = spark.sparkContext.broadcast(Bloom(classes.where("alive = 1").select("row")))
    sets = sets_of(docs, wanted).repartition(tasks, "cid").sortWithinPartitions("cid")
    chunks = Staged(chunks_of(sets, parts), "chunks")
    counted = count(chunks.df.where("kind = 1").repartitionById(tasks, at_part).sortWithinPartitions("part").select("part", "chunk", "blob"))
    both = counted.unionByName(chunks.df.where("kind = 0").select("chunk", "part", "blob"))
    packed = Staged(first_shingles(both.repartition(tasks, "chunk").sortWithinPartitions("chunk", "part"), parts), "prefixes")
    by_hash = packed.df.repartitionById(tasks, at_part).sortWithinPartitions("part")
    nodes = Staged(components(forests(by_hash)).join(classes.select("cid", "weight", "least"), "cid"), "nodes").df

    unpacked = map_columns(chunks.df.where("kind = 0").select("blob"), _sets, "cid long, n long, tokens binary")
    sizes = nodes.join(unpacked.select("cid", "n"), "cid").groupBy("root").agg(F.count("*").alias("many"), F.sum("n").alias("size"))
    beyond = Staged(sizes.where((F.col("many") > together[0]) | (F.col("size") > together[1])).select("root", F.lit(True).alias("far")), "beyond").df
    far = None
    if not beyond.isEmpty():
        marked = Staged(lookup(nodes, beyond, ["root"], "left"), "marked").df
        nodes, far = marked.where("far is null").drop("far"), marked.where("far").drop("far")
    sets = unpacked.select("cid", "tokens")
    placed = nodes.join(sets, "cid").select("root", "cid", "weight", "least", "tokens")
    linked = settle(placed.repartition(tasks, "root").sortWithinPartitions("root", "cid"))
    if far is not None:
        linked = linked.unionByName(visited(far, by_hash, sets, tasks, block))
    linked = Staged(linked, "links").df
    chunks.drop()
    packed.drop()

    result = classes.join(linked, "cid", "left").select("cid", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_similar"), F.when(F.col("links").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    full = lookup(meta.where("n > 0"), Staged(result, "result").df, ["cid"]).select("doc_id", F.col("n").alias("n_shingles"), "n_similar", "component_id", F.col("cid").alias("class_id"), "row")
    none = meta.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_similar"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_id"), "row")
    return full.unionByName(none)


def _sets(_: object, blobs: list) -> dict:
    cid, n, tokens = [], [], []
    for b in blobs:
        c, k, t = unpack_sets(b)
        cid += c.tolist()
        n += k.tolist()
        tokens += [s.tobytes() for s in split(t, k)]
    return {"cid": cid, "n": n, "tokens": tokens}


def row_key(df: DataFrame, id_col: str, text_col: str):
    """A hash of id and text, by which a row is known again."""
    return F.xxhash64(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, of which one of each component stays: the one of the smallest id.

    Of several rows with that id one stays. Of rows without id whose component has no id
    one of each class stays. Rows without words are in no group and all stay. Columns of
    any name come through.
    """
    found = near_duplicates(df, id_col, text_col).where("n_shingles > 0")
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min("row").alias("row")).select("row")
    nameless = found.where("component_id is null").groupBy("class_id").agg(F.min("row").alias("row")).select("row")
    key = next(k for i in range(len(df.columns) + 1) if (k := f"_row{i}") not in {c.lower() for c in df.columns})
    stays = first.unionByName(nameless).select(F.col("row").alias(key)).distinct()
    marked = df.withColumn(key, row_key(df, id_col, text_col))
    # a text with a character other than white space has a word
    words = F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    chosen = marked.where(words).join(stays, key).dropDuplicates([key]).drop(key)
    return chosen.select(*df.columns).unionByName(df.where(~words))


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "n_similar", "component_id")


#: SQL for small tables; it pairs documents by shared shingles.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS x FROM s),
h AS (SELECT doc_id, x FROM (SELECT doc_id, x, count(*) OVER (PARTITION BY x) AS k FROM e) WHERE k > 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM h a JOIN h b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * i >= 70 * (a.n + b.n - i)),
r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v)
SELECT n.doc_id, n.n AS n_shingles, (SELECT count(*) FROM l WHERE l.u = n.doc_id)::BIGINT AS n_similar, (SELECT min(v) FROM r WHERE r.u = n.doc_id) AS component_id FROM n
"""
