"""Licences whose words are frequent."""

import random

from sylvan.llm import license_scan as L

NOTICE = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"


def hot_row(k):
    """The notice in every third row; words that only other licences have in two of these."""
    return f"row {k} " + ("mit rights " if k in (0, 3) else "") + (NOTICE if k % 3 == 0 else "plain prose of the row")


def test_notice_in_a_third_of_the_rows(spark):
    rows = [(k, hot_row(k)) for k in range(90)]
    found = {r["doc_id"]: r["labels"] for r in L.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(("gpl-3" in found[k]) == (k % 3 == 0) for k in found)


def every(index, words):
    """Alignments when all words of all templates are looked up."""
    out = []
    for k, (label, t, keys) in enumerate(index.templates):
        for o in sorted({p - q for p, w in enumerate(words) for q, x in enumerate(t) if w == x}):
            got = [w for q, w in enumerate(t) if w in words[max(0, o + q - L.SLACK) : max(0, o + q + L.SLACK + 1)]]
            cover = sum(index.idf[w] for w in got) / index.weight[k]
            if cover >= L.COVER and all(L.occurrences(words[max(0, o - L.SLACK) : o + len(t) + L.SLACK], p) for p in keys):
                out.append((label, round(min(1.0, cover), 9), max(0, o), min(len(words), o + len(t)) - 1))
    return out


def test_rare_words_lose_no_alignment():
    r = random.Random(5)
    vocab = sorted({w for own in L.TEMPLATES.values() for t, _ in own for w in t.split()})
    for _ in range(60):
        index = L.Index({w: r.choice([0, 5, 50, 95, 100]) for w in vocab}, 100)
        text = r.choices(vocab, k=8)
        for _ in range(2):
            t = r.choice(r.choice(list(L.TEMPLATES.values())))[0].split()
            text += [x for w in t for x in (([] if r.random() < 0.08 else [w]) + ([r.choice(vocab)] if r.random() < 0.05 else []))] + r.choices(vocab, k=3)
        words = L.words_of(" ".join(text))
        assert [(a, round(c, 9), f, g) for a, c, f, g in index.scan(words)] == every(index, words)


def test_whole_texts_with_edits():
    """Words added, dropped and changed all over a licence's text leave it found, and other texts without a label."""
    r = random.Random(8)
    vocab = sorted({w for own in L.WHOLE.values() for t, _ in own for w in t.split()})
    prose = [f"w{k}" for k in range(400)] + ["the", "software", "any", "use", "notice", "of"] * 20
    index = L.Index({w: 40 if len(w) < 4 else 3 for w in vocab}, 100, {}, L.WHOLE)
    for label, own in L.WHOLE.items():
        for text, keys in own:
            for _ in range(20):
                words = L.words_of(text)
                fixed = {p + d for key in keys for p in L.occurrences(words, key.encode().split()) for d in range(len(key.split()))}
                out = []
                for k, w in enumerate(words):
                    x = 1.0 if k in fixed else r.random()
                    out += [] if x < 0.05 else [b"changed"] if x < 0.08 else [w, b"added"] if x < 0.12 else [w]
                lead = L.words_of(" ".join(r.choices(prose, k=r.randint(0, 300))))
                found = index.scan([*lead, *out, *L.words_of(" ".join(r.choices(prose, k=100)))])
                assert {f[0] for f in found} == {label}, (label, found)
                assert all(f[1] > 0.8 and abs(f[2] - len(lead)) <= len(words) // L.DRIFT * 2 for f in found)
    for _ in range(50):
        assert index.scan(L.words_of(" ".join(r.choices([*prose, *vocab], k=600)))) == []


def test_score_is_a_share(spark):
    rows = [(1, "Released under the MIT License."), (2, "it is under the mit license anyway"), (3, "nothing"), (4, None), (5, "cc by nc")]
    got = {x["doc_id"]: x for x in L.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["score"] == 1.0 and 0.5 < got[2]["score"] < 1.0 and got[3]["score"] == got[4]["score"] == 0.0 and 0 < got[5]["score"] < 1
    assert got[5]["labels"] == "cc-by-nc" and got[5]["n_base"] == 1
