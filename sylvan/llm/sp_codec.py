"""SentencePiece by a table of distinct chunks.

When no piece of a model has a whitespace marker after another character, merges never
cross the start of a run of markers. A text is then a row of chunks, each a run of
markers with the characters up to the next run; every distinct chunk is segmented
once and its ids, their decimal form and their decoding are joined back by position.
Models that break the condition, or normalise characters, are encoded whole.

Edge cases: null and empty texts have the end id alone and decode to the empty text;
repeated rows give repeated results; very long texts are processed whole (chunks over
256 characters are segmented but not kept in the table); an empty table gives an empty
table; only the named columns are read. Null ids stay null.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from sylvan.llm.common import doc_text, documents, kept, map_columns

MARK = "▁"
LONG, GROUP = 256, 16
#: A chunk without its first marker.
CHUNK = re.compile(f"[ {MARK}]([ {MARK}]*[^ {MARK}]*)")


def chunks(text: str) -> list[str]:
    """The chunks of a text that isn't empty, each without its first marker (the first text's chunk gets one from the library)."""
    if MARK in text or "  " in text or text[-1] == " " or text[0] == " ":
        return CHUNK.findall(" " + text)
    return text.split(" ")


class ChunkTable(dict):
    """Maps a chunk to its ids in decimal. ``odd`` has the decoding of chunks that don't decode to themselves."""

    def __init__(self, model_path: str, limit: int = 600_000):
        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.limit = limit
        self.eos = self.sp.eos_id()
        self.odd: dict[str, str] = {}
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.text_of = list(map(str, range(len(pieces))))
        self.lone = self.text_of[self.sp.piece_to_id(MARK)].encode()
        self.starts = np.array([p.startswith(MARK) for p in pieces])
        self.separable = self._separable()

    def _separable(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(self.sp.serialized_model_proto())
        norm = model.normalizer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
        own = any(p.type == 4 for p in model.pieces)  # user-defined pieces are matched before any merge
        crossing = any(MARK in p.piece.lstrip(MARK) for p in model.pieces)
        return plain and not own and not crossing and model.trainer_spec.model_type == 2 and not model.trainer_spec.treat_whitespace_as_suffix

    def fill(self, texts: list[str]) -> None:
        """Segment the chunks of these texts that the table doesn't have, each once.

        Short chunks of one marker are segmented some at a time in one string: as pieces
        don't cross, a piece that begins with a marker begins a chunk.
        """
        if not self.separable:
            return
        seen = {c for t in texts if t for c in chunks(t)}
        new = [c for c in seen - self.keys() if len(c) <= LONG]
        if len(self) + len(new) > self.limit:
            self.clear()
            self.odd.clear()
            new = [c for c in seen if len(c) <= LONG]
        single = [c for c in new if c and c[0] not in " " + MARK]
        for k in range(0, len(single), 4096):
            part = [single[i : i + GROUP] for i in range(k, min(k + 4096, len(single)), GROUP)]
            ids = self.sp.encode([" ".join(g) for g in part], num_threads=1)
            flat = np.array([i for x in ids for i in x])
            cuts = np.flatnonzero(self.starts[flat])
            words = [c for g in part for c in g]
            assert len(cuts) == len(words)
            flat = flat.tolist()
            cuts = cuts.tolist() + [len(flat)]
            own = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
            self._add(words, own)
        rest = [c for c in new if not c or c[0] in " " + MARK]
        self._add([c for c in rest if c], self.sp.encode([c for c in rest if c], num_threads=1))
        if "" in new:  # a lone marker, at the end of a text
            self[""] = self.lone

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        text_of = self.text_of
        for c, x, d in zip(words, ids, self.sp.decode(ids, num_threads=1)):
            self[c] = " ".join([text_of[i] for i in x]).encode()
            if d != c:
                self.odd[c] = d

    def __missing__(self, chunk: str) -> bytes:
        ids = self.sp.encode(chunk)
        if (d := self.sp.decode(ids)) != chunk:
            self.odd[chunk] = d
        return " ".join(map(str, ids)).encode() if chunk else self.lone

    def encode(self, text: str) -> tuple[bytes, int, str]:
        """Decimal ids with the end id, their number, the decoded text."""
        if not text:
            return str(self.eos).encode(), 1, ""
        if not self.separable:
            ids = self.sp.encode(text, add_eos=True)
            return " ".join(map(str, ids)).encode(), len(ids), self.sp.decode(ids)
        own = chunks(text)
        code = b" ".join(map(self.__getitem__, own)) + b" %d" % self.eos
        decoded = " ".join([self.odd.get(c, c) for c in own]) if self.odd else " ".join(own)
        return code, code.count(b" ") + 1, decoded


def chunk_table(model_path: str) -> ChunkTable:
    """One table for each Python worker, which serves many tasks, until another operator runs there."""
    return kept(__name__, model_path, lambda: ChunkTable(model_path))


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Number and digest of the ids and of the decoded text; with ``keep`` the ids and the decoded text too."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep

    def run(table: ChunkTable, ids: list, texts: list) -> dict:
        rows = []
        table.fill(texts)
        for i, text in zip(ids, texts):
            code, n, decoded = table.encode(text)
            rows.append((i, n, hashlib.sha256(code).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), list(map(int, code.split())) if keep else None, decoded))
        names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if keep else ()))
        return {k: [r[j] for r in rows] for j, k in enumerate(names)}

    return map_columns(doc_text(df, id_col, text_col), run, schema, lambda: chunk_table(model_path))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_texts(documents(spark, sf_dir), model_path())
