"""Personal data: stated patterns, and terms that give protected entities away.

Protected entities are the values that the stated patterns match. Over the whole corpus
their co-occurrence with terms is counted, a context once however often it is copied:
a context is the set of a text's terms, and all counts are of different contexts.
Of an entity e with information content IC(e) = -log2 p(e), a term t reveals
PMI(e, t) / IC(e) = 1 + log2 p(e | t) / IC(e): 1 where the term never occurs without
the entity, 0 where it tells nothing. In documents that hold the entity, terms from
``remove`` on are removed and those from ``generalise`` on generalised; both are
reported as spans of their own kinds. At least ``support`` different contexts must
have both, so a chance neighbour in one text is no disclosure.

Edge cases: null and empty texts have no spans; repeated rows give repeated results
and count as one context; very long texts are scanned whole (all scans are linear);
an empty table gives an empty table; only the named columns are read. Null ids stay
null. In ``sanitise`` a null text stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.common import Bloom, Staged, Taken, arrow_schema, doc_text, documents, forget, hash_spans, lookup, lowered, map_columns, scramble, unusual, utf8

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:\x20?[0-9]|-[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
KINDS = ("email", "ip", "card", "phone", "remove", "generalise")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SUPPORT, REMOVE, GENERALISE = 3, 0.95, 0.85
#: A task sums up after so many terms.
HELD_MOST = 2_000_000
LETTERS = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)])


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outward so that long runs without one cost nothing."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the stated patterns, by start and then kind as listed."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(s, e, 0) for s, e in emails(text)]
    out += [(*m.span(), 1) for m in IP.finditer(text) if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        out += [(*m.span(), 3) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    out.sort(key=lambda s: (s[0], s[2]))
    return [(s, e, KINDS[k]) for s, e, k in out]


def value_of(text: str, s: int, e: int, kind: str) -> str:
    """An entity in a form that doesn't depend on its writing."""
    raw = text[s:e]
    return f"{kind}:" + (raw.lower() if kind in ("email", "ip") else "".join(c for c in raw if c.isdigit()))


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(df: DataFrame) -> DataFrame:
    """Stated spans, entity values and context of every text; ``text_hash`` with doc_id names a text."""

    def run(_: object, ids: list, texts: list) -> dict:
        rows = []
        for i, text in zip(ids, texts):
            base = base_spans(text)
            kinds = [k for _, _, k in base]
            values = sorted({value_of(text, *s) for s in base})
            rows.append((i, hash_of(text), *(kinds.count(k) for k in KINDS[:4]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base), values))
        names = ("doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "entities")
        return {k: [r[j] for r in rows] for j, k in enumerate(names)} | {"context": contexts_of(pa.array(texts, pa.string())).tolist()}

    return map_columns(df, run, "doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, entities array<string>, context long")


def terms_of(text: str) -> set[str]:
    return {w.lower() for w in set(TERM.findall(text))}


def term_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct terms, sorted, one text after another; and their numbers."""
    data, offsets = utf8(column)
    odd = np.flatnonzero(unusual(np.frombuffer(data, np.uint8), offsets))
    if len(odd):  # their terms in lower case stand for them
        texts = [data[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        for k in odd.tolist():
            texts[k] = " ".join(terms_of(texts[k].decode())).encode()
        data, offsets = b" ".join(texts), np.cumsum([0, *(len(t) + 1 for t in texts)])
    size = len(data)
    low = np.frombuffer(lowered(data), np.uint8) if not len(odd) else np.frombuffer(_lowered_but(data, offsets, odd), np.uint8)
    ink = LETTERS[low[:size]]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    begins, ends = offsets[:-1][offsets[:-1] < size], offsets[1:][(offsets[1:] > 0) & (offsets[1:] <= size)] - 1
    first[begins] = ink[begins]
    last[ends] = ink[ends]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    chars = np.concatenate([[0], np.cumsum((low[:size] & 0xC0) != 0x80)])
    keep = chars[starts + lengths] - chars[starts] >= 3
    starts, lengths = starts[keep], lengths[keep]
    h = hash_spans(low.tobytes(), starts, lengths)
    bounds = np.searchsorted(starts, offsets).tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a > 1:
            h[a:b].sort()
    once = np.ones(len(h), bool)
    once[1:] = h[1:] != h[:-1]
    once[[a for a, b in zip(bounds, bounds[1:]) if b > a]] = True
    total = np.concatenate([[0], np.cumsum(once)])
    return h[once], np.diff(total[bounds])


def _lowered_but(data: bytes, offsets: np.ndarray, odd: np.ndarray) -> bytes:
    """In lower case, but for texts that are so already and have letters of which only a part of the bytes looks Latin."""
    low = lowered(data)
    for k in odd.tolist():
        low[offsets[k] : offsets[k + 1]] = data[offsets[k] : offsets[k + 1]]
    return bytes(low)


def contexts_of(column: pa.Array) -> np.ndarray:
    """A hash of each text's set of terms: the sum of theirs, mixed."""
    h, n = term_hashes(column)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    ends = np.cumsum(n)
    return scramble(total[ends] - total[ends - n]).view(np.int64)


def contexts(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """(entity, term) with the number of different contexts, for entities that ``wanted`` has.

    Texts are scanned again; one row leaves for each entity in a text, with its terms,
    and the context is the text's set of terms.
    """

    def run(_: object, ids: list, texts: list) -> dict:
        entity, terms, context = [], [], []
        for text, key in zip(texts, contexts_of(pa.array(texts, pa.string())).tolist()):
            values = {value_of(text, *s) for s in base_spans(text)}
            if values:
                own = sorted(terms_of(text))
                for v in sorted(values):
                    entity.append(v)
                    terms.append(own)
                    context.append(key)
        return {"entity": entity, "context": context, "terms": terms}

    seen = map_columns(df, run, "entity string, context long, terms array<string>")
    once = lookup_semi(seen, wanted).dropDuplicates(["entity", "context"])
    return once.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("both"))


def lookup_semi(big: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``big`` whose entity is wanted. A Bloom filter drops most others before any shuffle."""
    bits = big.sparkSession.sparkContext.broadcast(Bloom(wanted.select(F.xxhash64("entity"))))

    def run(_: object, entity: list, context: list, terms: list) -> dict:
        at = np.flatnonzero(bits.value.has(keys_of(entity))).tolist() if entity else []
        return {"entity": [entity[k] for k in at], "context": [context[k] for k in at], "terms": [terms[k] for k in at]}

    return map_columns(big, run, big.schema).join(wanted, "entity", "left_semi")


def keys_of(values: list[str]) -> np.ndarray:
    """Spark's xxhash64 of strings."""
    return np.array([xxhash.xxh64_intdigest(v, seed=42) for v in values], np.uint64).view(np.int64)


def term_counts(df: DataFrame, terms: DataFrame, repeated: DataFrame) -> DataFrame:
    """In how many different contexts each of these terms occurs, over all texts. Terms go by 64-bit hashes.

    Contexts that occur once are counted where they lie, and only sums travel. Those that
    ``repeated`` has (and some more, as a Bloom filter tells them) travel with their
    terms, once a task, so that each counts once however many copies there are.
    """
    spark = df.sparkSession
    named = Staged(map_columns(terms, lambda _, own: {"term": own, "h": [int(x) for x in hashes_of(own)]}, "term string, h long"), "pii-terms").df
    bits = spark.sparkContext.broadcast((Bloom(named.select("h")), Bloom(repeated.select("context"))))
    ddl = "context long, h binary, n binary"
    schema = arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(__name__)
        wanted, copied = bits.value
        done: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def total() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([h.tobytes()]), pa.array([n.astype(np.int64).tobytes()])], schema=schema)

        for batch in batches:
            h, n = term_hashes(batch.column(1))
            keys = contexts_of(batch.column(1))
            owner = np.repeat(np.arange(len(n)), n)
            on = wanted.has(h.view(np.int64)) if len(h) else np.empty(0, bool)
            h, owner = h[on], owner[on]
            many = copied.has(keys) if len(keys) else np.empty(0, bool)
            held.append(h[~many[owner]])
            size += len(held[-1])
            cuts = np.searchsorted(owner, np.arange(len(n) + 1))
            rows = []
            for k in np.flatnonzero(many).tolist():
                if (c := int(keys[k])) not in done:
                    done.add(c)
                    rows.append((c, h[cuts[k] : cuts[k + 1]].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows]), pa.array([x for _, x in rows], pa.binary()), pa.nulls(len(rows), pa.binary())], schema=schema)
            if size > HELD_MOST:
                yield total()
                held, size = [], 0
        if size:
            yield total()

    found = Staged(df.mapInArrow(run, ddl), "pii-counts").df
    once = found.where("context is null").unionByName(found.where("context is not null").dropDuplicates(["context"]))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of what a task reads, so that what travels is a row a term and task."""
        out = pa.schema([("h", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            h, n = [], []
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                h.append(np.frombuffer(x, np.int64))
                n.append(np.ones(len(h[-1]), np.int64) if y is None else np.frombuffer(y, np.int64))
            if h:
                keys, at = np.unique(np.concatenate(h), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(at, np.concatenate(n)).astype(np.int64))], schema=out)

    return once.mapInArrow(counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("alone")).join(named, "h").select("term", "alone")


def hashes_of(terms: list[str]) -> np.ndarray:
    """Hashes of terms as ``term_hashes`` has them."""
    data = [t.encode() for t in terms]
    size = np.array([len(x) for x in data], np.int64)
    return hash_spans(b"".join(data) + bytes(8), np.cumsum(size) - size, size).view(np.int64)


def disclosures(df: DataFrame, scanned: DataFrame, support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame | None:
    """(entity, terms array<struct<term, action>>) of revealing terms; None where no entity has the support."""
    counts = scanned.select(F.explode("entities").alias("entity"), "context").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    wanted = Staged(counts.where(F.col("n_entity") >= support), "pii-entities").df
    if wanted.isEmpty():
        return None
    pairs = Staged(contexts(df, wanted.select("entity")).where(F.col("both") >= support), "pii-pairs").df
    if pairs.isEmpty():
        return None
    often = Staged(scanned.groupBy("context").agg(F.count("*").alias("n")), "pii-contexts").df
    total = often.count()
    terms = Staged(pairs.select("term").distinct(), "pii-wanted").df
    alone = term_counts(df, terms, often.where("n > 1"))
    content = -F.log2(F.col("n_entity") / F.lit(float(total)))
    given = F.least(F.lit(1.0), F.col("both") / F.col("alone"))
    share = 1 + F.log2(given) / F.greatest(content, F.lit(1e-9))
    rated = pairs.join(alone, "term").join(wanted, "entity").withColumn("share", share).where(F.col("share") >= generalise)
    action = F.when(F.col("share") >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    return rated.groupBy("entity").agg(F.sort_array(F.collect_set(F.struct("term", action.alias("action")))).alias("terms"))


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE, keep_hash: bool = False) -> DataFrame:
    """Counts, digest and all spans of every text; ``keep_hash`` adds the text's hash."""
    docs = doc_text(df, id_col, text_col)
    scanned = Staged(scan(docs), "pii-scan").df
    out = ["doc_id", *(["text_hash"] if keep_hash else []), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rated = disclosures(docs, scanned, support, remove, generalise)
    if rated is None:
        return scanned.select(*out)
    rated = Staged(rated, "pii-terms").df
    if rated.isEmpty():
        return scanned.select(*out)
    width = 16 * F.size("terms") + F.aggregate("terms", F.lit(0), lambda n, x: n + F.octet_length(x["term"]))
    held_by = lookup(scanned.select("doc_id", "text_hash", F.explode("entities").alias("entity")).distinct(), rated, ["entity"], size=width)
    per_text = held_by.groupBy("doc_id", "text_hash").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    # only texts that hold an entity are read again, each once by its id and hash
    def run(_: object, ids: list, texts: list) -> dict:
        keep = [k for k, t in enumerate(texts) if base_spans(t)]
        return {"doc_id": [ids[k] for k in keep], "text_hash": [hash_of(texts[k]) for k in keep], "text": [texts[k] for k in keep]}

    holders = map_columns(docs, run, "doc_id long, text_hash long, text string").dropDuplicates(["doc_id", "text_hash"])
    both = holders.alias("a").join(per_text.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash"))).select("a.doc_id", "a.text_hash", "text", "terms")

    def mark(_: object, ids: list, hashes: list, texts: list, terms: list) -> dict:
        return {"doc_id": ids, "text_hash": hashes, "more": [joined(all_spans(t, x)) for t, x in zip(texts, terms)]}

    more = map_columns(both, mark, "doc_id long, text_hash long, more string")
    joined_rows = scanned.alias("s").join(more.alias("m"), F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("s.text_hash") == F.col("m.text_hash")), "left")
    return joined_rows.select(*(f"s.{c}" for c in out[:-1]), F.coalesce("m.more", "s.spans").alias("spans"))


def all_spans(text: str, terms: list) -> list[tuple[int, int, str]]:
    """Stated spans, and the revealing terms outside them."""
    base = base_spans(text)
    action: dict[str, str] = {}
    for x in terms:
        t, a = x["term"], x["action"]
        action[t] = "remove" if "remove" in (a, action.get(t)) else a
    out = list(base)
    taken = Taken(base)
    for m in TERM.finditer(text):
        a = action.get(m[0].lower())
        if a and not taken.meets(m.start(), m.end()):
            out.append((m.start(), m.end(), a))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def sanitise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """(doc_id, text) with spans replaced by their kind, revealing terms dropped or generalised to [TERM]."""
    found = find_personal(df, id_col, text_col, keep_hash=True, **options).select("doc_id", "text_hash", "spans").distinct()

    def key(_: object, ids: list, texts: list) -> dict:
        return {"doc_id": ids, "text": texts, "text_hash": [hash_of(t or "") for t in texts]}

    docs = map_columns(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), key, "doc_id long, text string, text_hash long")
    pairs = docs.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash")), "left").select("d.doc_id", "d.text", "f.spans")

    def run(_: object, ids: list, texts: list, spans: list) -> dict:
        return {"doc_id": ids, "text": [replace(t, s) if t and s else t for t, s in zip(texts, spans)]}

    return map_columns(pairs, run, "doc_id long, text string")


def replace(text: str, spans: str) -> str:
    out, at = [], 0
    for s, e, k in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(","))):
        if s >= at:
            out += [text[at:s], "" if k == "remove" else "[TERM]" if k == "generalise" else f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return find_personal(documents(spark, sf_dir))
