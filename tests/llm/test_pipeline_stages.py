"""Every stage of the corpus pipeline on a small table, against brute force, and the whole of it."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from sylvan.llm import packing, secret_scan, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(12)
    prose = lambda n: " ".join("".join(r.choice("abcdefghkmprst") for _ in range(5)) for _ in range(n))
    rows, labels = [], []
    for k in range(300):
        text = prose(40)
        if k % 6 == 0:
            text = text[:100] + " you gronk " + text[100:]
        if k % 7 == 1:
            text += ' token = "' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"'
        rows.append((k, text))
        labels.append((k, 1, int(k % 6 == 0)))
    near = rows[1][1].split()
    for k in range(20):
        words = list(near)
        words[r.randrange(len(words))] = f"w{k}"
        rows.append((400 + k, " ".join(words) if k % 2 else rows[1][1]))
    rows += [(900, None), (901, ""), (902, " \n"), (None, prose(12)), (903, prose(3000)), (2, rows[2][1])]
    d = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return str(d)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_stages_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in C.STAGES] == ["toxicity", "near duplicates", "secrets", "packing"]

    first = C.toxicity_filter(spark, docs, folder)
    assert first.columns == docs.columns
    model = toxicity.learn(toxicity.doc_text(docs), spark.read.parquet(f"{folder}/labels.parquet"))
    clean = [x for x in kept(docs) if toxicity.score_text(x[1] or "", toxicity.Matcher(model))[0] < toxicity.CUT]
    assert kept(first) == clean and not any(" gronk " in (t or "") for _, t in clean)
    assert {i for i, _ in clean} >= {i for i, t in kept(docs) if " gronk " not in (t or "")}

    second = C.near_duplicate_removal(spark, first, folder)
    assert second.columns == docs.columns
    sets = [shingle_set(t) for _, t in clean]
    group = list(range(len(clean)))
    for a in range(len(clean)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b]) and group[a] != group[b]:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    want = []
    for g in set(group):
        own = [clean[k] for k in range(len(clean)) if group[k] == g]
        if not shingle_set(own[0][1]):
            want += own
            continue
        ids = [i for i, _ in own if i is not None]
        want.append(next(x for x in own if x[0] == min(ids)) if ids else own[0])
    assert kept(second) == sorted(want, key=repr) and len(want) < len(clean) - 15

    third = C.secret_redaction(spark, second, folder)
    assert third.columns == docs.columns
    model = secret_scan.trained()
    marked = [(i, t if t is None else secret_scan.cut(t, secret_scan.add_scores(model, [t])[0][1])) for i, t in want]
    assert kept(third) == sorted(marked, key=repr) and sum("[SECRET]" in (t or "") for _, t in marked) > 20
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in third.collect())

    pieces = C.pack_sequences(spark, third, folder).collect()
    table = packing.TokenTable(packing.tokenizer_path())
    for i, t in marked:
        ids = np.array([*np.frombuffer(table.whole(t or ""), "<u2"), packing.END])
        own = sorted((r["start"], r["length"], r["ids_crc32"]) for r in pieces if r["doc_id"] == i)
        if sum(1 for j, _ in marked if j == i) == 1:
            assert [s for s, _, _ in own] == list(np.cumsum([0, *[n for _, n, _ in own[:-1]]])) and sum(n for _, n, _ in own) == len(ids)
            assert all(c == zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for s, n, c in own)
    assert len({r["sequence_id"] for r in pieces}) == len({(r["sequence_id"], r["offset"]) for r in pieces if r["offset"] == 0})


def test_run(spark, folder):
    whole = C.run(spark, folder)
    assert whole.columns == packing.PIECE.replace(" long", "").split(", ")
    rows = whole.collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in C.STAGES:
        docs = stage(spark, docs, folder)
    size = lambda rs: sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rs), key=repr)
    total = lambda rs: sorted(((r["doc_id"], r["doc_tokens"]) for r in rs if r["start"] == 0), key=repr)
    assert total(rows) == total(docs.collect()) and sum(r["length"] for r in rows) == sum(x[2] for x in size(docs.collect()))
