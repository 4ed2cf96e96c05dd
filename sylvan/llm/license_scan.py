"""Licence scan by a positional index of rare tokens.

Words of licence templates are weighed by their inverse document frequency over all
documents. Each template is looked up by its own rarest words, however frequent they
are: as many as weigh more than an alignment may lack, so that every alignment has one.
Postings that agree on the relative position (file position less template position,
with a little slack for edits; more of it in whole licence texts) align a template, and
an alignment counts when it covers enough of the template's weight and every mandatory
key phrase of the template stands inside the aligned stretch.

Edge cases: null and empty texts have no words, no labels and score 0; ties between
alignments go to the earliest position; repeated rows give repeated results; very long
texts are scanned whole; an empty table gives an empty table (its IDF is 1 for every
word); only the named columns are read. Null ids stay null.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import doc_text, documents, map_columns

#: What makes words: digits, letters, and every byte beyond ASCII; A-Z are lower-cased.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Stated phrases and the labels they give wherever their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: label: templates with their mandatory key phrases.
TEMPLATES: dict[str, list[tuple[str, list[str]]]] = {
    "mit": [
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted", "free of charge"]),
        ("released under the mit license", ["mit license"]),
    ],
    "apache-2": [
        ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license", "2 0"]),
        ("licensed under the apache license version 2 0", ["apache license"]),
    ],
    "cc-by-nc": [
        ("licensed under cc by nc 4 0", ["cc by nc"]),
        ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ],
    "cc-by-sa": [("this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]), ("licensed under cc by sa 4 0", ["cc by sa"])],
    "cc-by": [("this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4"])],
    "cc0": [("to the extent possible under law the author has waived all copyright and related or neighboring rights cc0", ["waived all copyright"])],
    "gpl-3": [
        ("this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
        ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"]),
    ],
    "gpl-2": [("licensed under the terms of the gnu general public license version 2", ["gnu general public license", "version 2"])],
    "lgpl": [("under the terms of the gnu lesser general public license", ["gnu lesser general public license"])],
    "agpl-3": [("under the terms of the gnu affero general public license version 3", ["gnu affero general public license"])],
    "bsd": [("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"])],
    "mpl-2": [("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"])],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute"])],
    "unlicense": [("this is free and unencumbered software released into the public domain", ["unencumbered software"])],
}
#: Whole texts, of which words may be missing, added or changed anywhere.
WHOLE: dict[str, list[tuple[str, list[str]]]] = {
    "mit": [
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
            ["permission is hereby granted", "without warranty of any kind"],
        )
    ],
    "isc": [
        (
            "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
            "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
            ["with or without fee", "disclaims all warranties"],
        )
    ],
    "bsd": [
        (
            "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
            "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
            "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
            "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
            ["redistribution and use in source and binary forms", "this list of conditions"],
        )
    ],
    "zlib": [
        (
            "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
            "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
            "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
            "altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
            ["must not be misrepresented", "altered source versions"],
        )
    ],
}
#: An alignment of a whole text may drift by one word in DRIFT of it.
SLACK, COVER, DRIFT = 2, 0.6, 10


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


class Index:
    """Positional postings of the templates, and the weights of their words."""

    def __init__(self, df: dict[str, int], n_docs: int, templates: dict = TEMPLATES, whole: dict | None = None):
        read = lambda some: [(label, t.encode().split(), [p.encode().split() for p in keys]) for label, own in some.items() for t, keys in own]
        self.templates = read(templates)
        #: From here on templates are whole texts.
        self.whole = len(self.templates)
        self.templates += read(whole or {})
        self.vocab = {w for _, t, _ in self.templates for w in t}
        self.idf = {w: math.log((n_docs + 1) / (df.get(w.decode(), 0) + 1)) + 1 for w in self.vocab}
        self.weight = [sum(self.idf[w] for w in t) for _, t, _ in self.templates]
        self.needed = [{w for p in keys for w in p} for _, _, keys in self.templates]
        self.rare = [self._rarest(t, (1 - COVER) * total) for (_, t, _), total in zip(self.templates, self.weight)]
        #: What an alignment that covers enough has of its rare words at least.
        self.least = [sum(self.idf[w] * len(at) for w, at in own.items()) - (1 - COVER) * total - 1e-9 for own, total in zip(self.rare, self.weight)]

    def _rarest(self, t: list[bytes], lack: float) -> dict[bytes, list[int]]:
        """The template's rarest words and their places, until they weigh more than ``lack``."""
        out: dict[bytes, list[int]] = {}
        for w in sorted(set(t), key=lambda w: (-self.idf[w], w)):
            out[w] = [q for q, x in enumerate(t) if x == w]
            lack -= self.idf[w] * len(out[w])
            if lack < -1e-6:
                break
        return out

    def scan(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """Verified alignments: label, share of the template's weight, first and last word."""
        present = self.vocab.intersection(words)
        live = [k for k, own in enumerate(self.needed) if own <= present]
        if not live:
            return []
        looked = present.intersection(set().union(*(self.rare[k] for k in live)))
        where: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(words):
            if w in looked:
                where[w].append(p)
        votes: dict[tuple[int, int], set[int]] = defaultdict(set)
        long = [k for k in live if k >= self.whole]
        live = [k for k in live if k < self.whole]
        for k in live:
            for w, at in self.rare[k].items():
                for p in where.get(w, ()):
                    for q in at:
                        votes[k, p - q].add(q)
        out = []
        for k, offset in sorted({(k, o + d) for k, o in votes for d in range(-SLACK, SLACK + 1)}):
            label, t, keys = self.templates[k]
            near = {q for d in range(-SLACK, SLACK + 1) for q in votes.get((k, offset + d), ())}
            if sum(self.idf[t[q]] for q in near) < self.least[k]:
                continue
            if (k, offset) not in votes and not any(0 <= offset + q < len(words) and words[offset + q] == w for q, w in enumerate(t)):
                continue  # no word at its very place
            # the template's other words count where they stand at their place, within the slack
            got = near | {q for q, w in enumerate(t) if q not in near and any(0 <= offset + q + d < len(words) and words[offset + q + d] == w for d in range(-SLACK, SLACK + 1))}
            cover = sum(self.idf[t[q]] for q in got) / self.weight[k]
            lo, hi = max(0, offset - SLACK), offset + len(t) + SLACK
            if cover >= COVER and all(occurrences(words[lo:hi], p) for p in keys):
                out.append((label, min(1.0, cover), max(0, offset), min(len(words), offset + len(t)) - 1))
        for k in long:
            out += self.drifting(k, words, where)
        return out

    def drifting(self, k: int, words: list[bytes], where: dict[bytes, list[int]]) -> list[tuple[str, float, int, int]]:
        """Alignments of a whole text: windows of relative positions that hold enough of its rare words, the heaviest of those that overlap."""
        label, t, keys = self.templates[k]
        votes = sorted((p - q, q) for w, at in self.rare[k].items() for p in where.get(w, ()) for q in at)
        width = len(t) // DRIFT
        counts: Counter = Counter()
        weight, first, windows = 0.0, 0, []
        for o, q in votes:
            counts[q] += 1
            weight += self.idf[t[q]] if counts[q] == 1 else 0.0
            while o - votes[first][0] > width:
                gone = votes[first][1]
                counts[gone] -= 1
                weight -= self.idf[t[gone]] if counts[gone] == 0 else 0.0
                first += 1
            if weight >= self.least[k]:
                windows.append((-weight, votes[first][0], o))
        out, used = [], []
        for _, low, high in sorted(windows):
            if any(low <= b and high >= a for a, b in used):
                continue
            used.append((low - width, high + width))
            lo, hi = max(0, low), min(len(words), high + len(t))
            places: dict[bytes, list[int]] = defaultdict(list)
            for p in range(lo, hi):
                places[words[p]].append(p)
            got = [w for q, w in enumerate(t) if w in places and (x := bisect.bisect_left(places[w], low + q)) < len(places[w]) and places[w][x] <= high + q]
            cover = sum(self.idf[w] for w in got) / self.weight[k]
            if cover >= COVER and all(occurrences(words[lo:hi], p) for p in keys):
                out.append((label, min(1.0, cover), lo, hi - 1))
        return sorted(out, key=lambda x: x[2])

    def phrase_share(self, phrase: list[bytes], label: str) -> float:
        """The largest share of a template's weight that a phrase in it has; where none has it, COVER."""
        own = [sum(self.idf[w] for w in phrase) / total for (name, t, _), total in zip(self.templates, self.weight) if name == label and occurrences(t, phrase)]
        return min(1.0, max(own, default=COVER))


def occurrences(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """All places where the phrase's words stand consecutively."""
    n, out, at = len(phrase), [], 0
    while True:
        try:
            at = words.index(phrase[0], at)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)
        at += 1


def document_frequencies(df: DataFrame, vocab: set[bytes]) -> tuple[dict[str, int], int]:
    """In how many documents each licence word occurs, over all documents, and their number. The vocabulary bounds the result."""

    def run(_: object, ids: list, texts: list) -> dict:
        counts: Counter = Counter()
        for text in texts:
            counts.update(vocab.intersection(words_of(text)))
        items = [(w.decode(), n) for w, n in counts.items()] + [("", len(texts))]
        return {"word": [w for w, _ in items], "n": [n for _, n in items]}

    rows = map_columns(df, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


def scan_licences(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict = TEMPLATES, whole: dict = WHOLE) -> DataFrame:
    """Phrase places and template alignments of every text; ``matches`` has the alignments.

    The score is the greatest share of a template's weight that an alignment or a stated
    phrase has.
    """
    docs = doc_text(df, id_col, text_col)
    vocab = {w for some in (templates, whole) for own in some.values() for t, _ in own for w in t.encode().split()}
    index = Index(*document_frequencies(docs, vocab), templates, whole)
    base = [(p.encode().split(), label) for p, label in phrases.items()]
    shares = [index.phrase_share(p, label) for p, label in base]
    needles = {p[0] for p, _ in base}

    def run(_: object, ids: list, texts: list) -> dict:
        rows = []
        for i, text in zip(ids, texts):
            words = words_of(text)
            places, base_labels, score = [], set(), 0.0
            if not needles.isdisjoint(words):
                for (phrase, label), share in zip(base, shares):
                    if found := occurrences(words, phrase):
                        places += found
                        base_labels.add(label)
                        score = max(score, share)
            found = index.scan(words)
            labels = base_labels | {m[0] for m in found}
            score = max([score, *(m[1] for m in found)])
            rows.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, [{"label": a, "cover": c, "first": f, "last": g} for a, c, f, g in found]))
        names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches")
        return {k: [r[j] for r in rows] for j, k in enumerate(names)}

    return map_columns(docs, run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,cover:double,first:long,last:long>>")


def op7_license(spark, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir)).drop("matches")
