"""WARC archives compressed with Zstandard and a shared dictionary.

An archive starts with a skippable frame that holds the dictionary and then has one
frame for each record. The writer deduplicates by payload digest: of records with equal
payloads the one with the smallest page_id is a response, the others are revisits that
name it. The reader loads the dictionary, decodes frame by frame and validates version,
headers, lengths and digests; records of any type (warcinfo, request, metadata and others) are read.

Archives are rows (name, content) as ``spark.read.format("binaryFile")`` gives them
too, so the reader serves files as well as tables. Archives are closed at about 4 MB of
payload, so none grows with the input.

Edge cases: a null or empty html is a record with an empty payload (digest of no
bytes), deduplicated like any other while the minimum size is 0; repeated page ids
with equal payloads: every row of the smallest id is a response; a null page_id sorts
after all others and refers to the smallest id, and a group of nulls alone is all
responses; an empty table gives no archives and no rows; a broken archive raises
WarcError in ``read_archive`` and gives a row with ``error`` in ``read_archives``.
Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.llm.common import Staged, arrow_schema, documents, lookup, map_columns, prepare

SKIPPABLE, FRAME_MAGIC, DICT_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
ARCHIVE_BYTES, LEVEL = 4 << 20, 3
TRAIN_ROWS, TRAIN_BYTES, TRAIN_CHARS, DICT_BYTES = 2000, 8 << 20, 1 << 14, 32 << 10
#: So many bytes of an archive are fed to the decoder at once.
PIECE = 1 << 14
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    pass


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, uri: str, key: str, payload: bytes, digest: str, refers_to: str | None = None, url: str | None = None, length: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone as its block and the full payload's length and digest in its headers."""
    block = HTTP + (payload if kind == "response" else b"")
    clean = (url or uri).replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{uri}>", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest_of(block)}", f"X-Page-Id: {key}", f"X-Payload-Length: {len(payload) if length is None else length}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    return SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def parse_record(raw: bytes) -> dict:
    """Headers, block and payload of one record, validated."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no header {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise WarcError(f"content length {headers['content-length']!r}, block of {len(rest) - 4} bytes")
    block = rest[:-4]
    if not same_digest(headers.get("warc-block-digest", ""), block):
        raise WarcError("block digest differs")
    payload = block
    # only HTTP messages have a head before their payload; warcinfo, metadata, resource and others are payload alone
    if headers.get("content-type", "").lower().replace(" ", "").startswith("application/http"):
        _, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise WarcError("no HTTP head in the block")
    # a revisit states the digest of a payload that it doesn't have
    if headers["warc-type"] != "revisit" and not same_digest(headers.get("warc-payload-digest", ""), payload):
        raise WarcError("payload digest differs")
    return {"headers": headers, "payload": payload}


def same_digest(stated: str, data: bytes) -> bool:
    """Whether data has a stated digest (algorithm:value, in base 32 or hex); one of an unknown algorithm isn't checked."""
    name, _, value = stated.strip().partition(":")
    name = name.lower().replace("-", "")
    if not value or name not in ("md5", "sha1", "sha256", "sha512"):
        return True
    own = hashlib.new(name, data).digest()
    return value.lower() in (own.hex(), base64.b32encode(own).decode().lower(), base64.b32encode(own).decode().lower().rstrip("="))


def read_archive(content: bytes) -> Iterator[dict]:
    """Records of an archive: offset, frame length, headers, payload. Raises WarcError where it is broken."""
    at, n, dictionary = 0, len(content), None
    if n >= 8 and int.from_bytes(content[:4], "little") == SKIPPABLE:
        size = int.from_bytes(content[4:8], "little")
        at = 8 + size
        if at > n:
            raise WarcError("the dictionary is cut off")
        raw = content[8:at]
        if raw[:4] == FRAME_MAGIC:  # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw and raw[:4] != DICT_MAGIC:
            raise WarcError("the leading frame holds no dictionary")
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(content)
    while at < n:
        magic = int.from_bytes(content[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + int.from_bytes(content[at + 4 : at + 8], "little")
            continue
        # fed in pieces, so that what follows a frame is never copied
        one, parts, end = decoder.decompressobj(), [], at
        try:
            while end < n and not one.eof:
                parts.append(one.decompress(view[end : end + PIECE]))
                end = min(n, end + PIECE)
        except zstandard.ZstdError as e:
            raise WarcError(f"bad frame at byte {at}: {e}") from e
        if not one.eof:
            raise WarcError(f"the frame at byte {at} is cut off")
        length = end - at - len(one.unused_data)
        try:
            yield {"offset": at, "length": length, **parse_record(b"".join(parts))}
        except (WarcError, UnicodeDecodeError) as e:
            raise WarcError(f"record at byte {at}: {e}") from e
        at += length


def train_dictionary(pages: DataFrame, html_col: str, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES, chars: int = TRAIN_CHARS) -> bytes:
    """A dictionary from a bounded sample; it alters sizes, never records.

    About ``rows`` pages at most, those whose hash is least, and the first ``chars``
    characters of each, are cut where they lie; at most ``most`` bytes are learned from.
    """
    text = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    share = rows / max(1, pages.count())
    some = pages if share >= 1 else pages.where(F.xxhash64(text) < F.lit(int((2 * share - 1) * (1 << 63))))
    found = some.select(F.xxhash64(text).alias("h"), F.substring(text, 1, chars).alias("t")).orderBy("h", "t").limit(rows)
    samples, total = [], 0
    for r in found.collect():
        s = r["t"].encode()
        if s and total + len(s) <= most:
            samples.append(s)
            total += len(s)
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little to learn from
        return b""


def write_archives(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", least: int = 0) -> DataFrame:
    """Archives (name, content, n_records) with a record for each page."""
    spark = pages.sparkSession
    prepare(spark)
    url = F.col(url_col) if url_col else F.lit(None)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), url.cast("string").alias("url")).withColumn("digest", F.unhex(F.sha1("html")))
    dictionary = train_dictionary(pages, html_col)
    # digests without the pages: 28 bytes for each, written once; what follows reads only them
    ids = Staged(own.select("page_id", "digest", (F.octet_length("html") >= least).alias("counts")), "warc-digests").df.where("counts").drop("counts")
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    repeats = lookup(ids, firsts, ["digest"]).where("page_id is null or page_id > first")
    revisits = repeats.groupBy("page_id", "digest").agg(F.min("first").alias("first"))
    marked = own.join(revisits, own["page_id"].eqNullSafe(revisits["page_id"]) & (own["digest"] == revisits["digest"]), "left").select(own["page_id"], "html", "url", "first")
    schema = arrow_schema(T.StructType.fromDDL("name string, content binary, n_records long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        parts, size, count = [dictionary_frame(dictionary)], 0, 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{uuid.uuid4().hex}.warc.zst"]), pa.array([b"".join(parts)], pa.binary()), pa.array([count], pa.int64())], schema=schema)

        for batch in batches:
            for key, html, url, first in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode("utf-8", "surrogatepass")
                name = "" if key is None else str(key)
                raw = record("response" if first is None else "revisit", f"urn:page:{name}", name, payload, digest_of(payload), None if first is None else f"urn:page:{first}", url)
                parts.append(coder.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    parts, size, count = [dictionary_frame(dictionary)], 0, 0
        if count:
            yield close()

    return marked.mapInArrow(run, "name string, content binary, n_records long")


def read_archives(archives: DataFrame, content_col: str = "content", keep_payload: bool = False) -> DataFrame:
    """One row for each record of each archive; a broken archive gives one more row, with ``error``."""
    item = "page_id:long,record_type:string,payload_bytes:long,payload_digest:string,refers_to:long,target_uri:string,record_offset:long,record_length:long,payload:binary,error:string"

    def run(_: object, contents: list) -> dict:
        out = []
        for content in contents:
            rows: list[dict] = []
            try:
                for r in read_archive(content or b""):
                    h = r["headers"]
                    kind = h["warc-type"]
                    full = len(r["payload"]) if kind != "revisit" else int(h.get("x-payload-length", 0))
                    if kind == "response" and "x-payload-length" in h and full != int(h["x-payload-length"]):
                        raise WarcError(f"payload of {full} bytes, {h['x-payload-length']} stated")
                    refers = h.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                    key = h.get("x-page-id", "")
                    rows.append({"page_id": int(key) if key else None, "record_type": kind, "payload_bytes": full, "payload_digest": re.sub("^sha-?1:", "", h.get("warc-payload-digest", ""), flags=re.I), "refers_to": int(refers) if refers.lstrip("-").isdigit() else None, "target_uri": h.get("warc-target-uri"), "record_offset": r["offset"], "record_length": r["length"], "payload": r["payload"] if keep_payload else None, "error": None})
            except WarcError as e:
                rows.append({"error": str(e)})
            out.append(rows)
        return {"records": out}

    return map_columns(archives.select(F.col(content_col)), run, f"records array<struct<{item}>>").select(F.explode("records").alias("r")).select("r.*")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Archives are written to the shared folder and read back from there; errors would be rows without page_id."""
    archives = Staged(write_archives(documents(spark, sf_dir, "pages")), "warc").df
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: base-32 of the SHA-1 from its hex form: each 5 bits of it picks a letter.
_BITS = "list_aggregate(list_transform(range(1, 41), lambda i: right(bin(('0x' || sha1(coalesce(html, ''))[i])::INT + 16), 4)), 'string_agg', '')"
OP8_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, {_BITS} AS bits FROM pages),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(list_aggregate(list_transform(range(1, 6), lambda j: (bits[k * 5 + j])::INT * (1 << (5 - j)::INT)), 'sum')::BIGINT + 1)]), 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END::BIGINT AS refers_to FROM f
"""
