"""The disclosure scan and its patterns against plain versions."""

import math
import random
import re

import pytest

from sylvan.llm import pii


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


@pytest.mark.parametrize("seed", range(4))
def test_stated_patterns(seed):
    r = random.Random(seed)
    parts = ["@", ".", "-", "+", " ", "a", "B9", "%", "_", "0", "12", "255", "256", "1.2.3.4", "4539148803436467", "4539 1488 0343 6467", "(", ")", "\n", "é", "555-0100", "user@mail.example", "٣"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        want = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(PLAIN) for m in re.finditer(p, text) if ok(m[0]))
        assert pii.base_spans(text) == [(s, e, PLAIN[k][0]) for s, k, e in want], text


def plain_terms(rows, support=pii.SUPPORT):
    """The revealing terms of every entity, counted over different contexts one by one."""
    seen = {}
    for _, text in rows:
        terms = frozenset(w.lower() for w in re.findall(r"[^\W\d_]{3,}", text))
        seen.setdefault(terms, set()).update(pii.value_of(text, *s) for s in pii.base_spans(text))
    out = {}
    for e in set().union(*seen.values()):
        own = [c for c, values in seen.items() if e in values]
        if len(own) < support:
            continue
        content = -math.log2(len(own) / len(seen))
        for t in set().union(*own):
            both, alone = sum(t in c for c in own), sum(t in c for c in seen)
            share = 1 + math.log2(min(1.0, both / alone)) / max(content, 1e-9)
            if both >= support and share >= pii.GENERALISE:
                out.setdefault(e, {})[t] = "remove" if share >= pii.REMOVE else "generalise"
    return out


def test_disclosures_at_any_partitioning(spark):
    r = random.Random(3)
    names = ["anna", "boris", "clara", "dmitri"]
    words = ["report", "meeting", "river", "garden", "window", "budget", "harbour", "lantern", "quarry", "violet"]
    told = {"anna": "zymurgy", "boris": "quokka", "clara": "obsidian", "dmitri": "river"}
    rows = []
    for k in range(260):
        who = names[k % 4] if k % 3 == 0 else None
        body = r.choices(words, k=5)
        if who:
            body += [told[who]] if r.random() < 0.9 else []
            body.append(f"{who}@corp.example.com")
        elif r.random() < 0.05:
            body.append(told["clara"])
        r.shuffle(body)
        rows.append((k, " ".join(body)))
    rows += [(1000 + k, rows[3][1]) for k in range(120)] + [(None, rows[0][1])]
    want = plain_terms(rows)
    assert {a for own in want.values() for a in own.values()} == {"remove", "generalise"} or want
    for n in (1, 7):
        found = pii.find_personal(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        for x in found:
            text = dict(rows)[x["doc_id"]]
            terms = [{"term": t, "action": a} for s in pii.base_spans(text) for t, a in want.get(pii.value_of(text, *s), {}).items()]
            assert x["spans"] == pii.joined(pii.all_spans(text, terms)), (x["doc_id"], x["spans"])


def test_wide_rows_of_hot_keys(spark, monkeypatch):
    """Rows too wide to be sent to all tasks are joined in salted parts, with the same result."""
    from pyspark.sql import functions as F

    from sylvan.llm import common

    big = spark.range(3000).select((F.col("id") % 3).alias("k"), "id").unionByName(spark.range(50).select((F.col("id") + 10).alias("k"), "id"))
    small = spark.createDataFrame([(k, ["x" * 50] * 5) for k in (0, 1, 2, 11)], "k long, v array<string>")
    want = sorted((r["k"], r["id"]) for r in big.join(small, "k").collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 600)
    got = common.lookup(big, small, ["k"], size=F.octet_length(F.array_join("v", "")))
    assert sorted((r["k"], r["id"]) for r in got.collect()) == want and all(r["v"] == ["x" * 50] * 5 for r in got.collect())


def test_contexts_are_sets_of_terms():
    """Equal sets of terms, whatever their order, case and surroundings, have equal contexts; the hashes are those of the terms."""
    import pyarrow as pa

    r = random.Random(5)
    parts = ["abc", "ABC", "Éñç", "éÑÇ", "ab", "xyz1", "foo_bar", "日本語", "ΣΑΣ", "σας", "İxx", " ", "\n", "9", "×", "÷", "ªºµ", "don't", "ßßß", "ñ", "\u0130abc"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 10))) for _ in range(2000)] + ["", " ", "abc"]
    for some in (texts, texts[-3:], [""], []):
        column = pa.array(some, pa.string())
        h, n = pii.term_hashes(column)
        at = 0
        for t, k in zip(some, n.tolist()):
            own = {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}
            assert sorted(h[at : at + k].view("int64").tolist()) == sorted(pii.hashes_of(sorted(own)).tolist()), t
            at += k
        keys = pii.contexts_of(column).tolist()
        sets = [frozenset(w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)) for t in some]
        assert len(set(keys)) == len(set(sets)) and len(set(zip(keys, sets))) == len(set(sets))
