"""What keeps tasks small on large tables: plans and steps that would gather too much in one place."""

from collections import Counter, defaultdict

from sylvan.operators import lexical as L
from sylvan.operators import store as W
from sylvan.sources import tables as T

CHUNK = "/.meta{}/__meta__/chunks/1"


def batches(monkeypatch):
    """The plans of the batches that writes stage."""
    plans, cut = [], W.cut

    def keep(df, name="cut"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df, name)

    monkeypatch.setattr(W, "cut", keep)
    return plans


def test_writes_join_no_rows_without_owner(spark, monkeypatch):
    """Files have no owner: joined by it, the whole batch would go to one task."""
    plans = batches(monkeypatch)
    old = T.derive(spark.createDataFrame([("/a.py", "a")], "path string, content string"))
    rows = [("/b.py", "b", "file"), (CHUNK.format("/a.py"), "a", "chunk"), (CHUNK.format("/b.py"), "b", "chunk"), (CHUNK.format("/c.py"), "c", "chunk")]
    done = W.write(old, spark.createDataFrame(rows, "path string, content string, kind string"))
    assert "LeftOuter, (_owner" not in plans[0]
    assert {tuple(r) for r in done.errors.collect()} == {(CHUNK.format("/c.py"), "the chunk's file is missing")}
    assert {r[0] for r in done.entries.where("kind = 'chunk'").select("path").collect()} == {CHUNK.format("/a.py"), CHUNK.format("/b.py")}


def test_trigrams_are_counted_where_texts_lie(spark, monkeypatch):
    """No row for each gram of a text is shuffled; repeated paths count once."""
    monkeypatch.setattr(L, "GRAM_CHARACTERS", 10)
    rows = [("/a", "Banana \U0001f600banana"), ("/b", "ba"), ("/c", "naïve\nÄÖÜ"), ("/a", "ban"), ("/d", None), ("/e", "aaaaaaa"), ("/f", "xyz")]
    found = L.trigrams(spark.createDataFrame(rows, "path string, content string"))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    n, where = Counter(), defaultdict(set)
    for path, text in rows:
        t = (text or "").lower()
        for k in range(len(t) - 2):
            n[t[k : k + 3]] += 1
            where[t[k : k + 3]].add(path)
    assert {r["gram"]: (r["n"], r["files"]) for r in found.collect()} == {g: (n[g], len(where[g])) for g in n}
