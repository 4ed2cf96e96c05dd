"""A batch reads the texts of what it meets, and sends no others to another task."""

from sylvan.operators import store as W
from sylvan.sources import tables as T


def test_copies_shuffle_no_texts_of_others(spark, monkeypatch):
    """Texts of entries outside the batch stay where they lie: joins with all of them are by few paths, which are broadcast."""
    made, cut = [], W.cut

    def keep(df, name="cut"):
        made.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return cut(df, name)

    monkeypatch.setattr(W, "cut", keep)
    files = cut(T.derive(spark.createDataFrame([(f"/a/{k}.md", f"text {k}") for k in range(20)] + [("/copy/1.md", "old")], "path string, content string")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000")
    try:
        pairs = files.where("path like '/a/1%'").selectExpr("path as src", "concat('/copy/', substr(path, 4)) as dest")
        done = W.copy(files, pairs)
        names = [n for n, _ in made]
        assert names[:3] == ["pairs", "hits", "batch"]
        assert "BroadcastHashJoin [src" in made[2][1] and made[2][1].count("LeftSemi, BuildRight") == 1
        assert {(r["path"], r["content"]) for r in done.entries.where("kind = 'file' and path like '/copy/%'").select("path", "content").collect()} == {(f"/copy/{k}.md", f"text {k}") for k in [1, *range(10, 20)]}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
