"""Operators on small namespaces, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sylvan.operators import graph as Gr
from sylvan.operators import grep as Gp
from sylvan.operators import lexical as L
from sylvan.operators import scan as S
from sylvan.operators import store as W
from sylvan.operators import vector as V
from sylvan.operators.relation import Relation
from sylvan.plans.namespace import Namespace, PermissionMap
from sylvan.sources import tables as T

FILES = [("/src/a.py", "import b\nclass A:\n  pass\n"), ("/src/sub/b.py", "def f():\n  return 1\n"), ("/lib/c.py", "import a\nIMPORT x"), ("/notes.md", "read me\nimport all\nbye"), ("/empty.txt", "")]


@pytest.fixture(scope="module")
def entries(spark):
    return T.derive(T.with_directories(spark.createDataFrame(FILES, "path string, content string"))).cache()


def paths(rel, order=False):
    out = [r["path"] for r in (rel.ordered() if isinstance(rel, Relation) else rel).select("path").collect()]
    return out if order else sorted(out)


def test_scans(entries):
    assert paths(S.read(entries, ["/src/a.py", "/no"])) == ["/src/a.py"]
    assert [r["error"] for r in S.not_found(entries, ["/no"]).collect()] == ["Not found: /no"]
    assert paths(S.ls(entries, ["/src"])) == ["/src/a.py", "/src/sub"]
    assert paths(S.ls(entries, ["/"])) == ["/empty.txt", "/lib", "/notes.md", "/src"]
    assert paths(S.tree(entries, "/src", 1)) == ["/src/a.py", "/src/sub"]
    assert paths(S.glob(entries, "/src/**/*.py")) == ["/src/a.py", "/src/sub/b.py"]
    assert paths(S.glob(entries, "**/*.py", max_count=2), True) == ["/lib/c.py", "/src/a.py"]
    with pytest.raises(ValueError):
        S.tree(entries, "/", 0)


def test_grep(entries):
    got = {r["path"]: r["score"] for r in Gp.grep(entries, "import").df.collect()}
    assert got == {"/src/a.py": 1, "/lib/c.py": 1, "/notes.md": 1}
    assert {r["path"]: r["score"] for r in Gp.grep(entries, "import", case="insensitive", ext=["python"]).df.collect()} == {"/src/a.py": 1, "/lib/c.py": 2}
    lines = Gp.grep(entries, "import", paths=["/notes.md"], before=1).df.first()["lines"]
    assert [(x["start"], x["end"], x["match"]) for x in lines] == [(1, 2, 2)]
    assert paths(Gp.grep(entries, "e", invert=True, ext_not=["md"], output="files")) == ["/lib/c.py", "/src/a.py", "/src/sub/b.py"]


def test_relation(spark, entries):
    a = Relation.of(spark.createDataFrame([("/x", 1.0), ("/y", None), ("/z", 3.0)], "path string, score double"), "grep")
    b = Relation.of(spark.createDataFrame([("/y", 9.0, "file"), ("/w", 2.0, "file")], "path string, score double, kind string"), "glob")
    assert [(r["path"], r["score"], r["kind"]) for r in (a & b).df.collect()] == [("/y", 9.0, "file")]
    assert paths(a | b, True) == ["/x", "/y", "/z", "/w"] and (a | b).function == "hybrid"
    assert paths(a - b) == ["/x", "/z"] and paths(a.sort(), True) == ["/z", "/x", "/y"] and paths(a.sort(False), True) == ["/y", "/x", "/z"]
    assert paths(a.top(1)) == ["/z"] and paths(a.filter(lambda r: r["path"] != "/x")) == ["/y", "/z"] and paths(a.filter(F.col("score") > 2)) == ["/z"]
    assert paths(a.add_prefix("/m")) == ["/m/x", "/m/y", "/m/z"] and paths(b.kinds("file")) == ["/w", "/y"]
    with pytest.raises(ValueError):
        a.top(0)
    some = Relation.of(entries.where("path = '/notes.md'").select("path")).hydrate(entries, ["content"])
    assert some.df.first()["content"].startswith("read me")


def test_lexical_and_vectors(spark, entries):
    assert paths(L.lexical_search(entries, "return"), True) == ["/src/sub/b.py"]
    assert paths(L.lexical_search(entries, "nothing at")) == [] and paths(L.lexical_search(entries, "")) == []
    items = spark.createDataFrame([("/a", [1.0, 0.0]), ("/b", [0.0, 1.0]), ("/c", [1.0, 1.0])], "path string, embedding array<float>")
    assert paths(V.vector_search(items, [1, 0], 2), True) == ["/a", "/c"]
    with pytest.raises(ValueError):
        V.vector_search(items, [1, 0, 0])
    store = V.VectorStore(items).upsert(items.where("path = '/b'").withColumn("embedding", F.array(F.lit(5.0).cast("float"), F.lit(0.0).cast("float")))).delete(["/a"])
    assert paths(store.query([1, 0], 1, metric="inner")) == ["/b"]


def test_graph_forms_agree(spark):
    e = spark.createDataFrame([("/a", "/b"), ("/b", "/c"), ("/a", "/c"), ("/c", "/a"), ("/c", "/d"), ("/f", "/a")], "src string, dst string")
    value = lambda df: {r["path"]: round(r["score"], 6) for r in df.collect()}
    assert paths(Gr.descendants(e, ["/b"])) == ["/a", "/c", "/d"] and paths(Gr.ancestors(e, ["/a"])) == ["/b", "/c", "/f"]
    assert paths(Gr.predecessors(e, ["/c"])) == ["/a", "/b"] and paths(Gr.successors(e, ["/c"])) == ["/a", "/d"]
    assert value(Gr.betweenness_centrality(e).df) == value(Gr.betweenness_joins(e))
    small = Gr.LOCAL_EDGES
    near = value(Gr.closeness_centrality(e).df)
    try:
        Gr.LOCAL_EDGES = 1
        assert value(Gr.closeness_centrality(e).df) == near
    finally:
        Gr.LOCAL_EDGES = small
    chain = spark.createDataFrame([("/a", "/b"), ("/b", "/c"), ("/x", "/b")], "src string, dst string")
    assert paths(Gr.meeting_subgraph(chain, ["/a", "/c"]).kinds("directory")) == ["/a", "/b", "/c"]
    empty = chain.where("false")
    assert paths(Gr.pagerank(empty)) == [] and paths(Gr.hits(empty)) == []


def test_changes(spark, entries):
    now = F.lit("2021-01-01").cast("timestamp")
    rows = spark.createDataFrame([("/src/a.py", "new\n"), ("/new/dir/f.txt", "x"), ("/.meta/bad", "x"), ("/dup.txt", "1"), ("/dup.txt", "2")], "path string, content string")
    done = W.write(entries, rows, now=now)
    after = {r["path"]: r for r in done.entries.collect()}
    assert after["/src/a.py"]["content"] == "new\n" and after["/new/dir"]["kind"] == "directory" and "/dup.txt" not in after
    assert {r["path"] for r in done.errors.collect()} == {"/.meta/bad", "/dup.txt"}
    assert "/.meta/src/a.py/__meta__/versions/1" in after
    assert {r["path"] for r in W.write(entries, rows.limit(1), overwrite=False, now=now).errors.collect()} == {"/src/a.py"}
    gone = W.delete(entries, ["/src"], now=now)
    assert paths(S.live(gone.entries)) == ["/empty.txt", "/lib", "/lib/c.py", "/notes.md"]
    assert [r["error"] for r in W.delete(entries, ["/src"], cascade=False).errors.collect()] == ["Not empty: /src"]
    linked = W.mkedge(entries, spark.createDataFrame([("/src/a.py", "/lib/c.py", "uses")], "source string, target string, type string"), now=now)
    moved = W.move(linked.entries, "/lib", "/pkg/lib", now=now)
    assert {(r["src"], r["dst"]) for r in Gr.edges_of(moved.entries).collect()} == {("/src/a.py", "/pkg/lib/c.py")}
    assert "/pkg" in paths(S.live(moved.entries)) and W.move(entries, "/src", "/lib").errors.count() == 1
    edited = W.edit(entries, ["/notes.md", "/empty.txt"], [("read", "write", False)], now=now)
    assert edited.errors.count() == 1 and edited.entries.where("path = '/notes.md'").first()["content"].startswith("write me")


def test_namespace(spark, entries):
    space = Namespace(entries, PermissionMap(rules={"/lib": "read"}))
    space.mount("docs", Namespace(T.derive(spark.createDataFrame([("/guide.md", "import guide")], "path string, content string"))))
    assert paths(space.query("grep import -i | sort")) == ["/docs/guide.md", "/lib/c.py", "/notes.md", "/src/a.py"]
    assert paths(space.query("glob '/docs/*.md' & glob '/src/*.py'"), True) == ["/docs/guide.md", "/src/a.py"]
    assert not space.write([("/lib/x.txt", "no")]).success
    assert space.query("write /docs/new.md hello").success and "hello" in space.cli("cat /docs/new.md")
    assert space.query("mkedge /src/a.py /notes.md cites").success and paths(space.query("succ /src/a.py")) == ["/notes.md"]
    assert "/src/a.py" in space.cli("grep class --output path,score")
    users = Namespace(T.derive(spark.createDataFrame([("/u1/a.txt", "x"), ("/u2/b.txt", "y")], "path string, content string")), user_scoped=True)
    assert paths(users.query("glob '/*.txt'", user="u1")) == ["/a.txt"]
    with pytest.raises(ValueError):
        users.query("ls /")


def test_users_keep_to_their_trees(spark):
    rows = [("/u1", None, None), ("/u1/a.txt", "mine", "u1"), ("/u1/move.txt", "payload", "u1"), ("/u1/src/e.py", "x", "u1"), ("/u2/top.txt", "hidden", "u2")]
    space = Namespace(T.derive(spark.createDataFrame(rows, "path string, content string, owner_id string")), user_scoped=True)
    raw = lambda path: space.entries.where((F.col("path") == path) & F.col("deleted_at").isNull()).first()
    for wrong in (None, "", "a/b", ".."):
        for change in (lambda u: space.mkdir(["/d"], u), lambda u: space.edit(["/a.txt"], [("m", "n", False)], u), lambda u: space.mkedge("/a", "/b", "t", u), lambda u: space.transfer("/a.txt", "/b.txt", True, user=u), lambda u: space.delete(["/a.txt"], user=u), lambda u: space.write([("/a", "b")], user=u)):
            with pytest.raises(ValueError):
                change(wrong)
    assert space.query("cat /../u2/top.txt", user="u1").errors and not paths(space.query("cat /../u2/top.txt", user="u1"))
    assert not space.query("cp /u2/top.txt /loot.txt", user="u1").success and not paths(space.query("cat /loot.txt", user="u1"))
    done = space.query("edit /u2/top.txt hidden changed", user="u1")
    assert not done.success and "/u1/" not in done.errors[0]
    moved = space.query("mv /move.txt /u2/top.txt", user="u1")
    assert moved.success and paths(moved) == ["/u2/top.txt"]
    assert (raw("/u1/u2/top.txt")["content"], raw("/u1/u2/top.txt")["owner_id"], raw("/u2/top.txt")["content"]) == ("payload", "u1", "hidden")
    assert not space.query("rm /u2/nothing.txt", user="u1").success
    linked = space.query("mkedge /src/e.py /u2/top.txt imports", user="u1")
    edge = space.entries.where("kind = 'edge'").first()
    assert linked.success and (edge["source_path"], edge["target_path"]) == ("/u1/src/e.py", "/u1/u2/top.txt")
    assert paths(space.query("succ /src/e.py", user="u1")) == ["/u2/top.txt"]
    assert space.query("mkdir /u2/sub", user="u1").success and raw("/u1/u2/sub") and not raw("/u2/sub")
    assert [r["content"] for r in space.query("cat /top.txt", user="u2").df.collect()] == ["hidden"]


def test_reads_tell_what_is_missing(entries):
    space = Namespace(entries)
    assert space.query("cat /no.txt").errors == ("Not found: /no.txt",) and paths(space.query("cat /no.txt /notes.md")) == ["/notes.md"]
    assert space.query("stat /no.txt").errors and not space.query("stat /src").errors
    assert space.query("tree /no").errors == ("Not found: /no",) and space.query("tree /notes.md").errors == ("Not a directory: /notes.md",)
    assert space.query("tree / --depth 1").success and "ERROR: Not found: /no.txt" in space.cli("cat /no.txt")
    assert paths(space.query("glob /src | tree")) == ["/src/a.py", "/src/sub", "/src/sub/b.py"] and paths(space.query("glob /src | tree --depth 1")) == ["/src/a.py", "/src/sub"]


def test_included_kinds_come_on_top(spark, entries):
    linked = W.mkedge(entries, spark.createDataFrame([("/src/a.py", "/lib/c.py", "uses")], "source string, target string, type string")).entries
    space = Namespace(linked)
    shown = space.query("tree /.meta/src --include edge | kinds edge")
    assert len(paths(shown)) == 1 and paths(space.query("glob '/src/**' --include edge")) == paths(space.query("glob '/src/**'"))


def test_repeated_paths(spark):
    a = Relation.of(spark.createDataFrame([("/x", "first"), ("/x", "second"), ("/y", "only")], "path string, content string"))
    for got in (a & a, a | a):
        assert sorted((r["path"], r["content"]) for r in got.df.collect()) == [("/x", "second"), ("/y", "only")]
    assert paths(a - Relation.of(spark.createDataFrame([("/y",)], "path string"))) == ["/x"]


def test_write_keeps_what_it_found(spark, entries):
    one = W.write(entries, spark.createDataFrame([("/n.txt", "v1"), ("/m.txt", "w1")], "path string, content string")).entries.cache()
    changed = one.withColumn("content", F.when(F.col("path") == "/n.txt", F.lit("outside")).otherwise(F.col("content"))).where("path <> '/.meta/m.txt/__meta__/versions/1'")
    done = W.write(changed, spark.createDataFrame([("/n.txt", "v2"), ("/m.txt", "w2")], "path string, content string")).entries.cache()
    rows = {r["path"]: (r["created_by"], r["is_snapshot"]) for r in done.where("kind = 'version'").collect()}
    assert rows["/.meta/n.txt/__meta__/versions/2"] == ("external", True) and rows["/.meta/n.txt/__meta__/versions/3"] == ("auto", False)
    assert rows["/.meta/m.txt/__meta__/versions/2"] == ("repair", True) and rows["/.meta/m.txt/__meta__/versions/3"] == ("auto", False)
    texts = {(r["path"], r["version_number"]): r["content"] for r in W.reconstruct(done).where("path = '/n.txt'").collect()}
    assert texts == {("/n.txt", 1): "v1", ("/n.txt", 2): "outside", ("/n.txt", 3): "v2"}
    again = W.write(done, spark.createDataFrame([("/n.txt", "v2")], "path string, content string")).entries
    assert again.where("path = '/n.txt'").first()["version_number"] == 3


def test_batches_of_moves(spark):
    rows = T.derive(T.with_directories(spark.createDataFrame([("/a/x.txt", "1"), ("/a/b/y.txt", "2"), ("/c.txt", "3")], "path string, content string")))
    rows = W.mkedge(rows, spark.createDataFrame([("/a/x.txt", "/c.txt", "t"), ("/c.txt", "/a/b/y.txt", "t")], "source string, target string, type string")).entries.cache()
    pairs = [("/a", "/d/a"), ("/a/b", "/d/b"), ("/c.txt", "/d/c.txt"), ("/gone", "/d/gone"), ("/a/x.txt", "/a/x.txt/y")]
    done = W.moves(rows, spark.createDataFrame(pairs, "src string, dest string"))
    assert paths(S.live(done.entries).where("kind <> 'edge' and kind <> 'version' and path not like '/.meta%'")) == ["/d", "/d/a", "/d/a/b", "/d/a/b/y.txt", "/d/a/x.txt", "/d/c.txt"]
    assert {(r["src"], r["dst"]) for r in Gr.edges_of(done.entries).collect()} == {("/d/a/x.txt", "/d/c.txt"), ("/d/c.txt", "/d/a/b/y.txt")}
    assert {r["path"] for r in done.errors.collect()} == {"/a/b", "/gone", "/a/x.txt"}


def test_zero_vectors(spark):
    items = spark.createDataFrame([("/a", [0.0, 0.0]), ("/b", [1.0, 1.0])], "path string, embedding array<float>")
    assert [(r["path"], round(r["score"], 6)) for r in V.vector_search(items, [1, 1], 2).ordered().collect()] == [("/b", 1.0), ("/a", 0.0)]


def test_changes_over_mounts(spark):
    make = lambda *rows: Namespace(T.derive(T.with_directories(spark.createDataFrame(list(rows), "path string, content string"))))
    space, one, two = make(("/r.txt", "root")), make(("/a.txt", "old")), make(("/b.txt", "old"))
    space.mount("one", one)
    space.mount("two", two)
    assert space.query("edit /one/a.txt old new").success and [r["content"] for r in space.query("cat /one/a.txt").df.collect()] == ["new"]
    assert space.query("mkdir /two/sub/deep").success and "/two/sub/deep" in paths(space.query("ls /two/sub"))
    assert paths(space.query("cp /one/a.txt /two/c.txt")) == ["/two/c.txt"] and space.query("mv /two/c.txt /one/d.txt").success
    gone = paths(space.query("glob '/*/*.txt' | rm"))  # with the versions of the files
    assert [p for p in gone if not p.startswith("/.meta")] == ["/one/a.txt", "/one/d.txt", "/two/b.txt"] and "/.meta/one/a.txt/__meta__/versions/1" in gone
    assert paths(space.query("glob '/**/*.txt'")) == ["/r.txt"]


def test_token_windows(spark):
    df = spark.createDataFrame([("/a", "a b c d e f g"), ("/b", " "), ("/c", "x y")], "path string, content string")
    rows = sorted((r["path"], r["chunk_no"], r["token_start"], r["token_end"], " ".join(r["tokens"])) for r in T.token_windows(df, 4, 1).collect())
    assert rows == [("/a", 0, 0, 4, "a b c d"), ("/a", 1, 3, 7, "d e f g"), ("/c", 0, 0, 2, "x y")]


def test_chunks(spark):
    df = spark.createDataFrame([("/a", "one\ntwo\nthree\nfour"), ("/b", "")], "path string, content string")
    rows = sorted((r["chunk_no"], r["line_start"], r["line_end"], r["content"]) for r in T.line_chunks(df, 8).collect())
    assert rows == [(0, 1, 2, "one\ntwo"), (1, 3, 4, "three\nfour")]
    assert "two\nthree\nfour" in [r["content"] for r in T.line_chunks(df, 8, 1).collect()]


def test_streaming_ingest(spark, tmp_path):
    from sylvan.streaming.ingest import EntryTable, ingest

    folder = tmp_path / "in"
    spark.createDataFrame([("/a.txt", "1", "2024-01-01"), ("/a.txt", "2", "2024-01-02")], "path string, content string, ts string").select("path", "content", F.col("ts").cast("timestamp")).write.parquet(str(folder))
    table = EntryTable(spark, str(tmp_path / "table"))
    stream = spark.readStream.schema("path string, content string, ts timestamp").parquet(str(folder))
    q = ingest(stream, table).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["content"] for r in table.read().where("path = '/a.txt'").collect()] == ["2"]
    EntryTable.COMPACT = 2
    for n in range(1, 6):
        batch = spark.createDataFrame([("/a.txt", f"v{n}"), (f"/new{n}.txt", "x")], "path string, content string").withColumn("ts", F.current_timestamp())
        table.upsert(batch, n)
        table.upsert(batch.withColumn("content", F.lit("replayed")), n)
    rows = {r["path"]: r["content"] for r in table.read().where("kind = 'file'").collect()}
    assert rows == {"/a.txt": "v5", **{f"/new{n}.txt": "x" for n in range(1, 6)}}
    assert [n for n, _ in table._written()] == [0, 1, 2, 3, 4, 5] or len(table._written()) < 6
