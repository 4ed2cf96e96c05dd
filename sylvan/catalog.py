"""Registry of the engine's queries over the given tables, and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import paths as P
from sylvan.functions import patterns as G
from sylvan.functions import text as X
from sylvan.operators import graph as Gr
from sylvan.operators import grep as Gp
from sylvan.operators import lexical as L
from sylvan.operators import scan as S
from sylvan.operators import store as W
from sylvan.operators import vector as V
from sylvan.operators.relation import Relation
from sylvan.plans.namespace import Namespace
from sylvan.sources import tables as T

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
EN = "/docs/en"


def query(sql: str | None = None, name: str | None = None):
    def keep(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn

    return keep


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def files(*more: str) -> str:
    """A WITH clause over the same rows as entries()."""
    dirs = "dirs AS (SELECT DISTINCT '/' || array_to_string(p[1:k], '/') AS path FROM (SELECT string_split(path[2:], '/') AS p FROM files) q, unnest(range(1, len(p))) r(k))"
    ent = "entries AS (SELECT path, 'file' AS kind, content, octet_length(encode(content)) AS size_bytes FROM files UNION ALL SELECT path, 'directory', NULL, NULL FROM dirs)"
    return "WITH RECURSIVE " + ",\n".join([T.FILES_SQL, dirs, ent, *more]) + "\n"


LINES = "lines AS (SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no, len(string_split(content, chr(10))) AS n_lines FROM files WHERE content <> '')"
WORDS = "toks AS (SELECT path, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS term FROM files)"


def ranked(rel: Relation, *cols: str) -> DataFrame:
    """Rows with their place in the order, for results of a few rows (top-k)."""
    from pyspark.sql import Window

    w = Window.orderBy(*rel.order)  # k rows only
    return rel.df.select(F.row_number().over(w).cast("long").alias("place"), *cols)


# scans


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cli_pipeline(spark, sf_dir)


ASKED = ["/docs/en/src1/1.txt", "/pages/7.html", "/conv/0/0.md", "/nowhere.md"]
_ASKED = ", ".join(f"'{p}'" for p in ASKED)


@query(files() + f"SELECT path, kind, content, size_bytes FROM entries WHERE path IN ({_ASKED})")
def read_paths(spark, d):
    return S.read(T.entries(spark, d), ASKED).select("path", "kind", "content", "size_bytes")


@query(files() + f"SELECT p AS path, 'Not found: ' || p AS error FROM unnest([{_ASKED}]) t(p) WHERE p NOT IN (SELECT path FROM entries)")
def read_missing(spark, d):
    return S.not_found(T.entries(spark, d), ASKED)


@query(files() + "SELECT path, sha256(content) AS content_hash, size_bytes, (CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END)::INTEGER AS lines, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS parent_path, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext, len(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''))::INTEGER AS lexical_tokens FROM entries WHERE kind = 'file'")
def stat_entries(spark, d):
    return T.entries(spark, d).where("kind = 'file'").select("path", "content_hash", "size_bytes", "lines", "name", "parent_path", "ext", "lexical_tokens")


@query(files() + "SELECT path, kind FROM entries WHERE regexp_replace(path, '/[^/]*$', '') = '/docs/en'")
def ls_children(spark, d):
    return S.ls(T.entries(spark, d), [EN]).select("path", "kind")


@query(files() + "SELECT path, kind FROM entries WHERE path LIKE '/docs/%' AND length(path) - length(replace(path, '/', '')) <= 3")
def tree_depth(spark, d):
    return S.tree(T.entries(spark, d), "/docs", 2).select("path", "kind")


@query(files() + "SELECT path, kind FROM entries WHERE path LIKE '/conv/%'")
def tree_all(spark, d):
    return S.tree(T.entries(spark, d), "/conv").select("path", "kind")


@query(files() + "SELECT path FROM dirs")
def dirs_from_paths(spark, d):
    return T.with_directories(T.text_files(spark, d).select("path")).where("kind = 'directory'").select("path")


def _glob(name: str, pattern: str, regex: str, **options) -> None:
    sql = files() + f"SELECT path, kind FROM entries WHERE regexp_full_match(path, '{regex}', 's')"
    query(sql, name)(lambda spark, d: S.glob(T.entries(spark, d), pattern, **options).select("path", "kind"))


_glob("glob_star", "/docs/*/src1*", "/docs/[^/]*/src1[^/]*")
_glob("glob_question", "/docs/en/src?/*1.txt", "/docs/en/src[^/]/[^/]*1\\.txt")
_glob("glob_doublestar", "/docs/**/*7.md", "/docs/(.*/)?[^/]*7\\.md")
_glob("glob_class", "/docs/[!e]*/src[12]/*", "/docs/[^e][^/]*/src[12]/[^/]*")
_glob("glob_ext_prefix", "/docs/en/**/*.py", "/docs/en/(.*/)?[^/]*\\.py")
_glob("glob_relative", "**/1*.html", "/(.*/)?1[^/]*\\.html")


@query(files() + "SELECT path, row_number() OVER (ORDER BY path COLLATE \"C\") AS place FROM entries WHERE regexp_full_match(path, '/docs/(.*/)?[^/]*\\.rst') ORDER BY path LIMIT 20")
def glob_max_count(spark, d):
    return ranked(S.glob(T.entries(spark, d), "/docs/**/*.rst", max_count=20), "path")


@query(files() + "SELECT path FROM entries WHERE kind = 'file' AND regexp_matches(path, '\\.(md|markdown|mdown|mkdn|py|pyi)$')")
def type_filter(spark, d):
    return S.live(T.entries(spark, d)).where("kind = 'file'").where(S.structural(ext=["markdown", "python"])).select("path")


@query(files() + "SELECT path FROM entries WHERE kind = 'file' AND NOT regexp_matches(path, '\\.(md|markdown|mdown|mkdn|html|htm)$') AND (path LIKE '/docs/fr/%' OR path LIKE '/pages/%')")
def type_not_filter(spark, d):
    return S.live(T.entries(spark, d)).where("kind = 'file'").where(S.structural(ext_not=["md", "html"], paths=["/docs/fr", "/pages"])).select("path")


@query(files() + "SELECT path, parse AS kind, depth, ext FROM (SELECT path, CASE WHEN position('.' IN regexp_extract(path, '[^/]*$')) > 0 THEN 'file' ELSE 'directory' END AS parse, (length(path) - length(replace(path, '/', '')))::INTEGER AS depth, nullif(lower(regexp_extract(path, '[^/]\\.([^./]{1,32})$', 1)), '') AS ext FROM entries)")
def path_functions(spark, d):
    p = F.col("path")
    return T.entries(spark, d).select("path", P.kind_col(P.normalize_col(p)).alias("kind"), P.depth_col(p).alias("depth"), P.extension_col(p).alias("ext"))


# grep


def _grep(name: str, where: str, pattern: str, **options) -> None:
    sql = files(LINES) + f"SELECT path, line_no::INTEGER AS line_no, line FROM lines WHERE {where}"
    query(sql, name)(lambda spark, d: Gp.matching_lines(T.text_files(spark, d), pattern, **options).select("path", "line_no", "line"))


_grep("grep_lines", "regexp_matches(line, 'th[ei]ng?er')", "th[ei]ng?er")
_grep("grep_fixed_ci", "contains(lower(line), 'apache license, version 2.0')", "apache license, version 2.0", case="smart", fixed=True)
_grep("grep_word", "regexp_matches(line, '(^|[^\\p{L}\\p{N}_])license([^\\p{L}\\p{N}_]|$)', 'i')", "license", case="insensitive", word=True)
_grep("grep_invert", "NOT regexp_matches(line, 'e')", "e", invert=True)
_grep("grep_smart", "regexp_matches(line, 'The ')", "The ", case="smart")
_grep("grep_anchor", "regexp_matches(line, '^The .*\\.$')", r"^The .*\.$")


@query(files(LINES) + "SELECT path, count(*)::DOUBLE AS score FROM lines WHERE regexp_matches(line, 'ing\\.') GROUP BY path")
def grep_count(spark, d):
    return Gp.grep(T.entries(spark, d), r"ing\.", output="count").select("path", "score")


@query(files(LINES) + "SELECT DISTINCT path FROM lines WHERE regexp_matches(line, 'idiot|moron') AND regexp_matches(path, '^/docs/.*\\.(txt|text|md|markdown|mdown|mkdn)$') AND NOT regexp_matches(path, '^/(.*/)?src1/')")
def grep_files(spark, d):
    return Gp.grep(T.entries(spark, d), "idiot|moron", paths=["/docs"], ext=["txt", "md"], globs_not=["**/src1/**"], output="files").select("path")


@query(files(LINES) + "SELECT path, score, row_number() OVER (ORDER BY path) AS place FROM (SELECT path, count(*)::DOUBLE AS score FROM lines WHERE contains(line, 'License') GROUP BY path ORDER BY path LIMIT 10)")
def grep_max_count(spark, d):
    return ranked(Gp.grep(T.entries(spark, d), "License", fixed=True, max_count=10), "path", "score")


_ISLANDS = (
    "hit AS (SELECT path, line_no, greatest(1, line_no - 1) AS lo, least(n_lines, line_no + 2) AS hi FROM lines WHERE contains(line, 'License'))",
    "mark AS (SELECT *, CASE WHEN lo > coalesce(lag(hi) OVER (PARTITION BY path ORDER BY line_no), -1) + 1 THEN 1 ELSE 0 END AS fresh FROM hit)",
    "isl AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY line_no) AS island FROM mark)",
)


@query(files(LINES, *_ISLANDS) + "SELECT path, (min(lo) OVER w)::INTEGER AS \"start\", (max(hi) OVER w)::INTEGER AS \"end\", line_no::INTEGER AS \"match\" FROM isl WINDOW w AS (PARTITION BY path, island)")
def grep_context(spark, d):
    out = Gp.grep(T.entries(spark, d), "License", fixed=True, before=1, after=2)
    return out.df.select("path", F.explode("lines").alias("x")).select("path", "x.start", "x.end", "x.match")


@query(files(LINES) + "SELECT path, count(*)::DOUBLE AS score FROM lines WHERE contains(line, 'License') AND path LIKE '/docs/en/%.md' GROUP BY path")
def grep_candidates(spark, d):
    e = T.entries(spark, d)
    return Gp.grep(e, "License", fixed=True, candidates=S.glob(e, "/docs/en/**/*.md")).select("path", "score")


# set algebra

_AB = ("a AS (SELECT path, count(*)::DOUBLE AS score FROM lines WHERE contains(line, 'License') GROUP BY path)", "b AS (SELECT path, kind, size_bytes FROM entries WHERE path LIKE '/docs/en/%' AND kind = 'file')")


def _sides(spark, d):
    e = T.entries(spark, d)
    return Gp.grep(e, "License", fixed=True, output="count"), S.stat(e, S.tree(e, EN).kinds("file"))


@query(files(LINES, *_AB) + "SELECT path, score, size_bytes FROM a JOIN b USING (path)")
def intersect_paths(spark, d):
    a, b = _sides(spark, d)
    return (a & b).select("path", "score", "size_bytes")


@query(files(LINES, *_AB) + "SELECT path, score, size_bytes, coalesce(b.kind, 'file') AS kind FROM a FULL JOIN b USING (path)")
def union_left_wins(spark, d):
    a, b = _sides(spark, d)
    return (a | b).select("path", "score", "size_bytes", "kind")


@query(files(LINES, *_AB) + "SELECT path, size_bytes FROM b WHERE path NOT IN (SELECT path FROM a)")
def except_paths(spark, d):
    a, b = _sides(spark, d)
    return (b - a).select("path", "size_bytes")


@query(files(LINES, *_AB) + "SELECT a.path, score, size_bytes, content FROM a JOIN entries USING (path)")
def hydrate_projection(spark, d):
    e = T.entries(spark, d)
    return Gp.grep(e, "License", fixed=True, output="count").hydrate(e, ["content", "size_bytes"]).select("path", "score", "size_bytes", "content")


@query(files(LINES, *_AB) + "SELECT row_number() OVER (ORDER BY score DESC, path) AS place, path, score FROM a ORDER BY score DESC, path LIMIT 25")
def top_k(spark, d):
    return ranked(_sides(spark, d)[0].top(25), "path", "score")


@query(files() + "SELECT path, kind FROM entries WHERE kind = 'directory'")
def kinds_filter(spark, d):
    return S.tree(T.entries(spark, d)).kinds("directory").select("path", "kind")


# ranked retrieval

_BM = (
    WORDS, "f AS (SELECT path, content FROM files WHERE content IS NOT NULL)", "len AS (SELECT path, count(*) AS n FROM toks GROUP BY path)",
    "st AS (SELECT (SELECT count(*) FROM {scope})::DOUBLE AS n, (SELECT count(*) FROM toks WHERE path IN (SELECT path FROM {scope}))::DOUBLE AS t)", "ps AS (SELECT path FROM {scope} WHERE {some})",
    "df AS (SELECT term, count(DISTINCT path)::DOUBLE AS df FROM toks WHERE path IN (SELECT path FROM ps) GROUP BY term)", "m AS (SELECT avg(ln((st.n - df + 0.5) / (df + 0.5))) AS mean FROM df, st)",
    "q AS (SELECT unnest([{terms}]) AS term, unnest([{boost}]) AS k)", "w AS (SELECT term, k * CASE WHEN ln((st.n - df + 0.5) / (df + 0.5)) < 0 THEN greatest(0, 0.25 * mean) ELSE ln((st.n - df + 0.5) / (df + 0.5)) END AS w FROM df JOIN q USING (term), st, m)",
    "tf AS (SELECT path, term, count(*)::DOUBLE AS tf FROM toks JOIN q USING (term) WHERE path IN (SELECT path FROM ps) GROUP BY path, term)",
    "sc AS (SELECT path, sum(w * tf * 2.5 / (tf + 1.5 * 0.25 + 1.5 * 0.75 * len.n / (st.t / st.n))) AS score FROM tf JOIN w USING (term) JOIN len USING (path), st GROUP BY path)",
)


def _bm25_sql(terms: dict[str, float], scope: str = "f") -> str:
    some = " OR ".join(f"contains(lower(content), '{t}')" for t in terms)
    fill = {"scope": scope, "some": some, "terms": ", ".join(f"'{t}'" for t in terms), "boost": ", ".join(f"{k:.1f}" for k in terms.values())}
    parts = [p.format(**fill) if "{scope}" in p or "{terms}" in p else p for p in _BM]
    return files(*parts) + "SELECT row_number() OVER (ORDER BY round(score, 9) DESC, path) AS place, path, round(score, 6) AS score FROM sc WHERE score > 0 ORDER BY round(score, 9) DESC, path LIMIT 15"


def _bm25(rel: Relation) -> DataFrame:
    return ranked(rel, "path", F.round("score", 6).alias("score"))


@query(_bm25_sql({"license": 1, "password": 1, "idiot": 1}))
def bm25_topk(spark, d):
    return _bm25(L.lexical_search(T.entries(spark, d), "license password idiot"))


@query(_bm25_sql({"mit": 2, "apache": 1}))
def bm25_repeat_term(spark, d):
    return _bm25(L.lexical_search(T.entries(spark, d), "MIT apache mit"))


@query(_bm25_sql({"license": 1, "gnu": 1}, "(SELECT * FROM f WHERE path LIKE '/docs/en/%')"))
def bm25_candidates(spark, d):
    e = T.entries(spark, d)
    return _bm25(L.lexical_search(e, "license gnu", candidates=S.tree(e, EN).kinds("file")))


@query(files(WORDS) + "SELECT (SELECT count(*) FROM files WHERE content IS NOT NULL) AS n_docs, (SELECT count(*) FROM toks) AS n_tokens")
def corpus_stats(spark, d):
    return L.corpus_stats(L.corpus(T.entries(spark, d)))


@query(files(WORDS) + "SELECT term, count(*) AS tf, count(DISTINCT path) AS df FROM toks GROUP BY term")
def term_frequencies(spark, d):
    rows = T.text_files(spark, d).select("path", F.explode(X.tokens_col(F.col("content"))).alias("term")).groupBy("term", "path").count()
    return rows.groupBy("term").agg(F.sum("count").alias("tf"), F.count("*").alias("df"))


_VEC = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), v AS (SELECT '/vec/' || label || '/' || vec_id AS path, label, embedding::DOUBLE[] AS e FROM embeddings)\n"


def _vectors(spark, d) -> tuple[DataFrame, list[float]]:
    e = T.table(spark, d, "embeddings")
    first = e.orderBy("vec_id").limit(1).first()
    return e.select(F.concat(F.lit("/vec/"), "label", F.lit("/"), "vec_id").alias("path"), "embedding", "label"), list(first["embedding"])


def _vector(name: str, metric: str, sql: str) -> None:
    text = _VEC + f"SELECT row_number() OVER (ORDER BY s DESC, path) AS place, path, round(s, 6) AS score FROM (SELECT path, {sql} AS s FROM v, q) ORDER BY s DESC, path LIMIT 20"

    @query(text, name)
    def run(spark, d):
        items, q = _vectors(spark, d)
        return ranked(V.vector_search(items, q, 20, metric), "path", F.round("score", 6).alias("score"))


_vector("vector_cosine", "cosine", "list_dot_product(e, q) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(q, q))")
_vector("vector_ip", "inner", "list_dot_product(e, q)")
_vector("vector_l2", "l2", "1 / (1 + list_distance(e, q))")


@query(_VEC + "SELECT row_number() OVER (ORDER BY s DESC, path) AS place, path, round(s, 6) AS score FROM (SELECT path, list_dot_product(e, q) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(q, q)) AS s FROM v, q WHERE label = 3) ORDER BY s DESC, path LIMIT 10")
def vector_in_candidates(spark, d):
    items, q = _vectors(spark, d)
    return ranked(V.vector_search(items, q, 10, candidates=Relation.of(items.where("label = 3").select("path"))), "path", F.round("score", 6).alias("score"))


# graphs

_SEEDS = "('/customers/1', '/suppliers/2', '/parts/3')"
SEEDS = ["/customers/1", "/suppliers/2", "/parts/3"]


def _edge_sql(body: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([T.EDGES_SQL, *more]) + "\n" + body


@query(_edge_sql(f"SELECT DISTINCT src AS path FROM edges WHERE dst IN {_SEEDS} AND src NOT IN {_SEEDS}"))
def predecessors(spark, d):
    return Gr.predecessors(T.edges(spark, d), SEEDS).select("path")


@query(_edge_sql(f"SELECT DISTINCT dst AS path FROM edges WHERE src IN {_SEEDS} AND dst NOT IN {_SEEDS}"))
def successors(spark, d):
    return Gr.successors(T.edges(spark, d), SEEDS).select("path")


@query(_edge_sql(f"SELECT path FROM r WHERE path NOT IN ('/nations/3')", "r(path) AS (SELECT '/nations/3' UNION SELECT src FROM r JOIN edges ON dst = path)"))
def ancestors(spark, d):
    return Gr.ancestors(T.edges(spark, d), ["/nations/3"]).select("path")


@query("WITH RECURSIVE " + T.RING_SQL + ", r(path) AS (SELECT '/suppliers/2' UNION SELECT dst FROM r JOIN ring ON src = path) SELECT path FROM r WHERE path <> '/suppliers/2'")
def descendants(spark, d):
    return Gr.descendants(T.ring(spark, d), ["/suppliers/2"]).select("path")


@query(_edge_sql("SELECT path FROM (SELECT DISTINCT path FROM r) UNION ALL SELECT '/.meta' || src || '/__meta__/edges/out/' || max(type) || dst FROM edges WHERE src IN (SELECT path FROM r) AND dst IN (SELECT path FROM r) GROUP BY src, dst", "u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)", "r(path, k) AS (SELECT '/customers/1', 0 UNION SELECT dst, k + 1 FROM r JOIN u ON src = path WHERE k < 2)"))
def neighborhood_d2(spark, d):
    return Gr.neighborhood(T.edges(spark, d), ["/customers/1"], 2).select("path")


_DEGREE = ("p AS (SELECT DISTINCT src, dst FROM edges)", "d AS (SELECT path, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS path, 0 AS i, 1 AS o FROM p UNION ALL SELECT dst, 1, 0 FROM p) GROUP BY path)", "n AS (SELECT count(*) AS n FROM d)")


def _degree(name: str, which: str, value: str) -> None:
    query(_edge_sql(f"SELECT path, round(({value}) / (n - 1), 9) AS score, in_degree, out_degree FROM d, n", *_DEGREE), name)(lambda spark, d: Gr.degree_centrality(T.edges(spark, d), which).df.select("path", F.round("score", 9).alias("score"), "in_degree", "out_degree"))


_degree("degree_centrality", "both", "in_degree + out_degree")
_degree("in_degree", "in", "in_degree")
_degree("out_degree", "out", "out_degree")


def _pagerank_sql(rounds: int) -> str:
    parts = [T.RING_SQL, "nd AS (SELECT src AS path FROM ring UNION SELECT dst FROM ring)", "od AS (SELECT src AS path, count(*)::DOUBLE AS o FROM ring GROUP BY src)", "n AS (SELECT count(*)::DOUBLE AS n FROM nd)", "r0 AS MATERIALIZED (SELECT path, 1 / n AS r FROM nd, n)"]
    for k in range(1, rounds + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT nd.path, 0.15 / n + 0.85 * (coalesce(g, 0) + l / n) AS r FROM nd LEFT JOIN (SELECT dst AS path, sum(r / o) AS g FROM ring JOIN r{k - 1} p ON p.path = src JOIN od ON od.path = src GROUP BY dst) s ON s.path = nd.path, n, (SELECT coalesce(sum(r), 0) AS l FROM r{k - 1} WHERE path NOT IN (SELECT path FROM od)) z)")
    return "WITH " + ",\n".join(parts) + f" SELECT path, round(r, 7) AS score FROM r{rounds}"


@query(_pagerank_sql(20))
def pagerank_20(spark, d):
    return Gr.pagerank(T.ring(spark, d), rounds=20, tolerance=None).df.select("path", F.round("score", 7).alias("score"))


def _hits_sql(rounds: int) -> str:
    parts = [T.RING_SQL, "nd AS (SELECT src AS path FROM ring UNION SELECT dst FROM ring)", "h0 AS MATERIALIZED (SELECT path, 1.0::DOUBLE AS h FROM nd)"]
    for k in range(1, rounds + 1):
        parts.append(f"a{k} AS MATERIALIZED (SELECT dst AS path, sum(h) AS a FROM ring JOIN h{k - 1} p ON p.path = src GROUP BY dst)")
        parts.append(f"h{k} AS MATERIALIZED (SELECT path, s / max(s) OVER () AS h FROM (SELECT nd.path, coalesce(sum(a), 0) AS s FROM nd LEFT JOIN ring ON ring.src = nd.path LEFT JOIN a{k} ON a{k}.path = ring.dst GROUP BY nd.path))")
    return "WITH " + ",\n".join(parts) + f" SELECT nd.path, round(coalesce(a, 0) / (SELECT sum(a) FROM a{rounds}), 7) AS score FROM nd LEFT JOIN a{rounds} USING (path)"


@query(_hits_sql(20))
def hits_authority(spark, d):
    return Gr.hits(T.ring(spark, d), rounds=20, tolerance=None).df.select("path", F.round("score", 7).alias("score"))


_DIST = "WITH RECURSIVE " + T.RING_SQL + ", nd AS (SELECT src AS path FROM ring UNION SELECT dst FROM ring), x(root, path, k) AS (SELECT path, path, 0 FROM nd UNION SELECT root, dst, k + 1 FROM x JOIN ring ON src = path WHERE k < 12), ds AS (SELECT root, path, min(k) AS k FROM x GROUP BY root, path)\n"


#: Too slow in SQL over the whole graph: compared with it on a small one, in the tests.
CLOSENESS_SQL = _DIST + ", c AS (SELECT path, count(*) AS m, sum(k) AS far FROM ds GROUP BY path) SELECT path, round(CASE WHEN far > 0 THEN (m - 1) / far * (m - 1) / ((SELECT count(*) FROM nd) - 1) ELSE 0 END, 9)::DOUBLE AS score FROM c"


@query()
def closeness(spark, d):
    return Gr.closeness_centrality(T.ring(spark, d)).df.select("path", F.round("score", 9).alias("score"))


def _between_sql(depth: int) -> str:
    parts = ["s0 AS MATERIALIZED (SELECT path AS root, path, 1.0::DOUBLE AS s FROM nd)"]
    for k in range(1, depth + 1):
        parts.append(f"s{k} AS MATERIALIZED (SELECT p.root, ring.dst AS path, sum(p.s) AS s FROM s{k - 1} p JOIN ring ON ring.src = p.path JOIN ds ON ds.root = p.root AND ds.path = ring.dst AND ds.k = {k} GROUP BY p.root, ring.dst)")
    every = " UNION ALL ".join(f"SELECT root, path, s, {k} AS k FROM s{k}" for k in range(depth + 1))
    parts.append(f"sg AS MATERIALIZED ({every})")
    parts.append(f"b{depth} AS MATERIALIZED (SELECT root, path, 0.0::DOUBLE AS b FROM sg WHERE k = {depth})")
    for k in range(depth - 1, -1, -1):
        parts.append(f"b{k} AS MATERIALIZED (SELECT v.root, v.path, coalesce(sum(v.s / w.s * (1 + c.b)), 0) AS b FROM sg v LEFT JOIN ring ON ring.src = v.path LEFT JOIN sg w ON w.root = v.root AND w.path = ring.dst AND w.k = {k + 1} LEFT JOIN b{k + 1} c ON c.root = w.root AND c.path = w.path WHERE v.k = {k} GROUP BY v.root, v.path)")
    total = " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(depth + 1))
    return _DIST + ", " + ",\n".join(parts) + f" SELECT nd.path, round(coalesce((SELECT sum(b) FROM ({total}) t WHERE t.path = nd.path AND t.root <> t.path), 0) / ((SELECT count(*) - 1 FROM nd) * (SELECT count(*) - 2 FROM nd)), 9)::DOUBLE AS score FROM nd"


BETWEENNESS_SQL = _between_sql(10)


@query()
def betweenness(spark, d):
    return Gr.betweenness_centrality(T.ring(spark, d)).df.select("path", F.round("score", 9).alias("score"))


@query()
def meeting_subgraph(spark, d):
    return Gr.meeting_subgraph(T.ring(spark, d), ["/suppliers/1", "/suppliers/5", "/parts/9"]).select("path", "kind")


@query()
def min_meeting_subgraph(spark, d):
    return Gr.meeting_subgraph(T.ring(spark, d), ["/suppliers/1", "/suppliers/5", "/parts/9"], minimal=True).select("path", "kind")


@query(_edge_sql("SELECT DISTINCT '/.meta' || dst || '/__meta__/edges/in/' || type || src AS path, 'edge' AS kind FROM edges UNION ALL SELECT DISTINCT '/.meta' || dst || '/__meta__/edges/in' || unnest(['', '/' || type]), 'directory' FROM edges"))
def edges_inverse_view(spark, d):
    return S.inverse_edges(T.edges(spark, d))


@query(_edge_sql("SELECT src AS source, dst AS target, type FROM edges"))
def edge_path_codec(spark, d):
    e = T.edges(spark, d).select(P.edge_out_col(F.col("src"), F.col("dst"), F.col("type")).alias("path"))
    return e.select(P.split_edge_col(F.col("path")).alias("e")).select("e.source", "e.target", "e.type")


# changes


@query(files() + "SELECT path, kind, path LIKE '/docs/en/%' OR path = '/docs/en' AS deleted FROM entries")
def soft_delete_cascade(spark, d):
    return W.delete(T.entries(spark, d), [EN]).entries.select("path", "kind", F.col("deleted_at").isNotNull().alias("deleted"))


@query(files() + "SELECT path, kind FROM entries WHERE NOT (path LIKE '/conv/%' OR path = '/conv')")
def permanent_delete(spark, d):
    return W.delete(T.entries(spark, d), ["/conv"], permanent=True).entries.select("path", "kind")


@query(files() + "SELECT CASE WHEN path = '/docs/en' THEN '/docs/english' WHEN path LIKE '/docs/en/%' THEN '/docs/english' || path[9:] ELSE path END AS path, kind FROM entries")
def move_prefix(spark, d):
    return W.move(T.entries(spark, d), EN, "/docs/english").entries.select("path", "kind")


@query(files() + "SELECT path, kind FROM entries UNION ALL SELECT '/copy/' || regexp_extract(path, '[^/]*$'), 'file' FROM entries WHERE path LIKE '/pages/%' UNION ALL SELECT '/copy', 'directory'")
def copy_content(spark, d):
    e = T.entries(spark, d)
    pairs = e.where("path like '/pages/%'").select(F.col("path").alias("src"), F.concat(F.lit("/copy/"), P.name_col(F.col("path"))).alias("dest"))
    return W.copy(e, pairs).entries.where("kind <> 'version'").select("path", "kind")


@query(files() + "SELECT path, kind, CASE WHEN path LIKE '/docs/fr/%' AND kind = 'file' THEN sha256(content || chr(10)) WHEN kind = 'file' THEN sha256(content) END AS content_hash FROM entries")
def overwrite_merge(spark, d):
    e = T.entries(spark, d)
    rows = e.where("path like '/docs/fr/%' and kind = 'file'").select("path", F.concat("content", F.lit("\n")).alias("content"))
    return W.write(e, rows).entries.where("kind <> 'version'").select("path", "kind", "content_hash")


_HISTORY = "h AS (SELECT '/src/' || lang || '/' || source || '.md' AS path, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n, text AS content FROM documents)"


def _history(spark, d) -> DataFrame:
    """Documents of one language and source as successive versions of one file."""
    key = ("lang", "source", "doc_id")
    docs = T.table(spark, d, "documents").select(*key, "text")
    rows = W.numbered(docs, key[:2], key[2], "text").select(F.concat(F.lit("/src/"), "lang", F.lit("/"), "source", F.lit(".md")).alias("path"), F.col("text").alias("content"), "_prev", "n")
    return W.version_rows(rows, F.lit("2020-01-01").cast("timestamp"))


@query("WITH " + _HISTORY + " SELECT '/.meta' || path || '/__meta__/versions/' || n AS path, n::INTEGER AS version_number, n = 1 OR n % 10 = 0 AS is_snapshot FROM h")
def version_numbers(spark, d):
    return _history(spark, d).select("path", "version_number", "is_snapshot")


@query("WITH " + _HISTORY + " SELECT path, n::INTEGER AS version_number, sha256(content) AS content_hash FROM h")
def version_reconstruct(spark, d):
    return W.reconstruct(_history(spark, d)).select("path", "version_number", F.sha2("content", 256).alias("content_hash"))


@query(files() + "SELECT path, replace(content, 'License', 'Licence') AS content FROM entries WHERE contains(content, 'License')")
def edit_exact_replace_all(spark, d):
    e = T.entries(spark, d).where("contains(content, 'License')")
    return e.select("path", X.edit_col(F.col("content"), "License", "Licence", True)["content"].alias("content"))


@query()
def edit_fuzzy(spark, d):
    e = T.entries(spark, d).where("contains(content, 'License')")
    return e.select("path", X.edit_col(F.col("content"), "   Released under the MIT License.  ", "(removed)").alias("x")).select("path", "x.success", "x.method", "x.error")


_RULES = [("/docs", "read"), ("/docs/en", "read_write"), ("/docs/en/src1", "read"), ("/pages", "read")]


@query(files() + "SELECT path, coalesce((SELECT arg_max(p, length(k)) FROM (VALUES " + ", ".join(f"('{k}', '{p}')" for k, p in _RULES) + ") t(k, p) WHERE path = k OR path LIKE k || '/%'), 'read_write') AS permission FROM entries")
def permission_resolve(spark, d):
    return W.resolve_rules(T.entries(spark, d), spark.createDataFrame(_RULES, "prefix string, permission string"))


def _mounted(spark, d) -> Namespace:
    e = T.entries(spark, d)
    root = Namespace(e.where("path not like '/docs%'"))
    sub = e.where("path like '/docs/%'").withColumn("path", F.substr("path", F.lit(6))).withColumn("parent_path", P.parent_col(F.col("path")))
    root.mount("docs", Namespace(sub))
    return root


@query(files() + "SELECT path, kind FROM entries WHERE path <> '/docs'")
def mount_resolve(spark, d):
    return _mounted(spark, d).all_entries().select("path", "kind")


@query(files() + "SELECT path FROM entries WHERE regexp_full_match(path, '/docs/(.*/)?[^/]*3\\.md')")
def mount_glob(spark, d):
    return _mounted(spark, d).query("glob '/docs/**/*3.md'").select("path")


@query("WITH ev AS (SELECT DISTINCT user_id, event_type FROM events) SELECT '/' || event_type || '.log' AS path FROM ev WHERE user_id = (SELECT min(user_id) FROM events)")
def user_scope(spark, d):
    ev = T.table(spark, d, "events").select("user_id", "event_type").distinct()
    rows = T.derive(ev.select(F.concat(F.lit("/u"), "user_id", F.lit("/"), "event_type", F.lit(".log")).alias("path")))
    user = T.table(spark, d, "events").agg(F.min("user_id")).first()[0]
    return Namespace(rows, user_scoped=True).view(f"u{user}").select("path")


@query(files() + "SELECT gram, count(*) AS n, count(DISTINCT path) AS files FROM (SELECT path, unnest(list_transform(range(1, length(content) - 1), lambda i: substring(lower(content), i, 3))) AS gram FROM files WHERE length(content) >= 3) GROUP BY gram")
def trigram_postings(spark, d):
    return L.trigrams(T.text_files(spark, d))


_CHUNKS = (
    "run AS (SELECT *, floor((sum(length(line) + 1) OVER (PARTITION BY path ORDER BY line_no) - length(line) - 1) / 1000)::INTEGER AS chunk_no FROM lines)",
    "ch AS (SELECT path, chunk_no, min(line_no)::INTEGER AS line_start, max(line_no)::INTEGER AS line_end, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS content_hash FROM run GROUP BY path, chunk_no)",
)


@query(files(LINES, *_CHUNKS) + "SELECT path, chunk_no, line_start, line_end, content_hash FROM ch")
def line_chunks(spark, d):
    return T.line_chunks(T.text_files(spark, d), 1000).select("path", "chunk_no", "line_start", "line_end", F.sha2("content", 256).alias("content_hash"))


@query(files("w AS (SELECT path, unnest(regexp_extract_all(content, '[^ ]+')) AS word, generate_subscripts(regexp_extract_all(content, '[^ ]+'), 1) - 1 AS k, len(regexp_extract_all(content, '[^ ]+')) AS n FROM files WHERE content IS NOT NULL)", "p AS (SELECT path, word, k, c AS chunk_no FROM w, unnest(range(greatest(0, (k - 200) // 150 + (k >= 200)::INTEGER), k // 150 + 1)) t(c) WHERE k < c * 150 + 200 AND (c = 0 OR c * 150 + 50 < n))") + "SELECT path, chunk_no, min(k) AS token_start, max(k) + 1 AS token_end, sha256(string_agg(word, ' ' ORDER BY k)) AS content_hash FROM p GROUP BY path, chunk_no")
def token_windows(spark, d):
    """Windows of 200 tokens, of which 50 overlap; spaces part tokens here."""
    rows = T.token_windows(T.text_files(spark, d), 200, 50, "[^ ]+")
    return rows.select("path", "chunk_no", "token_start", "token_end", F.sha2(F.array_join("tokens", " "), 256).alias("content_hash"))


# the language


@query(files(LINES) + "SELECT row_number() OVER (ORDER BY score DESC, path) AS place, path, score FROM (SELECT path, count(*)::DOUBLE AS score FROM lines WHERE regexp_matches(path, '^/docs/en/.*\\.md$') AND regexp_matches(line, '(^|[^\\p{L}\\p{N}_])the([^\\p{L}\\p{N}_]|$)') GROUP BY path) ORDER BY score DESC, path LIMIT 10")
def cli_pipeline(spark, d):
    return ranked(Namespace(T.entries(spark, d)).query("glob '/docs/en/**/*.md' | grep the -w | top 10 --output path,score"), "path", "score")


@query(files(LINES) + "SELECT path FROM entries WHERE regexp_full_match(path, '/pages/1[^/]*\\.html') UNION SELECT path FROM lines WHERE contains(line, 'idiot') AND path LIKE '/docs/%'")
def cli_union(spark, d):
    return Namespace(T.entries(spark, d)).query("glob '/pages/1*.html' & grep idiot /docs -F").select("path")


@query(files(LINES) + "SELECT path FROM (SELECT path FROM lines WHERE contains(line, 'idiot') INTERSECT SELECT path FROM entries WHERE path LIKE '/docs/en/%') EXCEPT SELECT path FROM lines WHERE contains(line, 'moron')")
def cli_sets(spark, d):
    return Namespace(T.entries(spark, d)).query("grep idiot -F | intersect (tree /docs/en) | except (grep moron -F)").select("path")


@query(files() + "SELECT path, kind FROM entries WHERE path LIKE '/docs/en/src1%' UNION ALL SELECT '/.meta' || path || '/__meta__/versions/1', 'version' FROM entries WHERE path LIKE '/docs/en/src1/%' AND kind = 'file'")
def include_kinds(spark, d):
    """A kind that is included comes on top of files and directories."""
    e = T.entries(spark, d)
    old = e.where("path like '/docs/en/src1/%' and kind = 'file'").select("path", "content", F.lit(None).cast("string").alias("_prev"), F.lit(1).alias("n"))
    space = Namespace(e.unionByName(W.version_rows(old, F.lit("2020-01-01").cast("timestamp"))))
    return space.query("glob '/docs/en/src1*' --include version & glob '/docs/en/src1*/**' --include version & tree '/.meta/docs/en' --include version | kinds file directory version").df.where("path not like '/.meta%' or kind = 'version'").select("path", "kind")


@query(files() + "SELECT path, 'right' AS content FROM entries WHERE path LIKE '/docs/en/%'")
def set_duplicates(spark, d):
    """Of repeated paths the last counts in set algebra."""
    own = S.tree(T.entries(spark, d), EN).select("path")
    twice = Relation.of(own.withColumn("content", F.lit("left")).unionByName(own.withColumn("content", F.lit("right"))))
    return ((twice & twice) | twice).select("path", "content")


@query(files("t AS (SELECT doc_id, doc_id % 3 AS how, '/f/' || doc_id || '.md' AS path FROM documents)") + "SELECT '/.meta' || path || '/__meta__/versions/' || n AS path, n::INTEGER AS version_number, who AS created_by, n <> (CASE WHEN how = 2 THEN 2 ELSE 3 END) AS is_snapshot FROM (SELECT *, unnest(CASE how WHEN 0 THEN [1, 2, 3] WHEN 1 THEN [2, 3] ELSE [1, 2] END) AS n, unnest(CASE how WHEN 0 THEN ['auto', 'external', 'auto'] WHEN 1 THEN ['repair', 'auto'] ELSE ['auto', 'auto'] END) AS who FROM t)")
def version_plan(spark, d):
    """Writes on files that were changed from outside (0), that lost their history (1), and on sound ones (2)."""
    docs = T.table(spark, d, "documents").select(F.concat(F.lit("/f/"), "doc_id", F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), (F.col("doc_id") % 3).alias("how"))
    first = W.write(T.derive(docs.where("false").select("path", "content")), docs.select("path", "content")).entries
    how = docs.select(F.col("path").alias("_p"), "how")
    odd = first.withColumn("_p", F.regexp_replace("path", "^/\\.meta(.*)/__meta__/versions/1$", "$1")).join(how, "_p", "left")
    odd = odd.where("not (kind = 'version' and how = 1)").withColumn("content", F.when((F.col("kind") == "file") & (F.col("how") == 0), F.concat("content", F.lit("!"))).otherwise(F.col("content"))).select(*first.columns)
    done = W.write(odd, docs.select("path", F.concat("content", F.lit("?")).alias("content")))
    return done.entries.where("kind = 'version'").select("path", "version_number", "created_by", "is_snapshot")


@query("WITH ev AS (SELECT DISTINCT user_id, event_type FROM events), u AS (SELECT min(user_id) AS a, max(user_id) AS b FROM events) SELECT '/u' || user_id || '/' || event_type || '.log' AS path, 'u' || user_id AS owner, 'seen' AS content FROM ev UNION ALL SELECT '/u' || a || '/u' || b || '/note.txt', 'u' || a, 'mine' FROM u UNION ALL SELECT '/u' || a || '/copy.log', 'u' || a, 'seen' FROM u")
def user_scope_writes(spark, d):
    """Whatever path one user names, the other's files stay as they are and are never read."""
    ev = T.table(spark, d, "events")
    rows = T.derive(ev.select("user_id", "event_type").distinct().select(F.concat(F.lit("/u"), "user_id", F.lit("/"), "event_type", F.lit(".log")).alias("path"), F.lit("seen").alias("content"), F.concat(F.lit("u"), "user_id").alias("owner_id")))
    low, high = ev.agg(F.min("user_id"), F.max("user_id")).first()
    own = ev.where(F.col("user_id") == low).agg(F.min("event_type")).first()[0]
    theirs = ev.where(F.col("user_id") == high).agg(F.min("event_type")).first()[0]
    space, user, other = Namespace(rows, user_scoped=True), f"u{low}", f"u{high}"
    space.write([(f"/{other}/note.txt", "mine")], user=user)
    space.edit([f"/{other}/{theirs}.log"], [("seen", "hacked", False)], user=user)
    space.transfers([(f"/../{other}/{theirs}.log", "/stolen.log"), (f"/{other}/{theirs}.log", "/stolen2.log")], False, user=user)
    space.delete([f"/{other}/{theirs}.log"], user=user)
    space.transfer(f"/{own}.log", "/copy.log", False, user=user)
    return space.entries.where("kind = 'file' and deleted_at is null").select("path", F.col("owner_id").alias("owner"), "content")


@query(files() + "SELECT CASE WHEN path LIKE '/docs/fr/%' THEN '/old' || path ELSE path END AS path, kind FROM entries WHERE path <> '/docs' AND path <> '/docs/fr' UNION ALL SELECT unnest(['/old', '/old/docs', '/old/docs/fr']), 'directory'")
def move_batch(spark, d):
    """A piped move is one change: directories go with all below them."""
    e = T.entries(spark, d)
    space = Namespace(e.where("path <> '/docs'"))
    space.query("glob '/docs/f[r]' | mv /old")
    return space.entries.select("path", "kind")


@query(files() + "SELECT path, kind, CASE WHEN kind = 'file' THEN sha256(CASE WHEN path LIKE '/docs/%' THEN replace(content, 'License', 'Licence') ELSE content END) END AS content_hash FROM entries WHERE path <> '/docs' UNION ALL SELECT '/docs/new', 'directory', NULL")
def mount_edit(spark, d):
    """Edits and new directories go to the mount that their path lies in."""
    space = _mounted(spark, d)
    space.query("grep License /docs -F -l | edit License Licence --all")
    space.query("mkdir /docs/new")
    return space.all_entries().where("kind <> 'version'").select("path", "kind", "content_hash")


def main() -> None:
    for name in QUERIES:
        print(name, "sql" if name in ORACLE else "rows")


if __name__ == "__main__":
    main()
