"""The graph queries cover all parts, whatever their keys."""

import duckdb
import pytest

from sylvan import catalog

ALL_PAIRS = {"closeness": catalog.CLOSENESS_SQL, "betweenness": catalog.BETWEENNESS_SQL}
TABLES = {
    "region": ("r_regionkey", [(0,), (1,)]), "nation": ("n_nationkey, n_regionkey", [(0, 0), (1, 1), (2, 0)]), "supplier": ("s_suppkey, s_nationkey", [(1, 0), (2, 1), (5, 2), (7, 1)]),
    "part": ("p_partkey, p_size", [(9, 0), (200, 3), (201, 5), (350, 5), (5000, 6)]), "lineitem": ("l_partkey, l_suppkey", [(9, 7), (200, 1), (201, 1), (201, 5), (350, 2), (350, 5), (5000, 2), (5000, 2)]),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("graph")
    for name, (cols, rows) in TABLES.items():
        duckdb.sql(f"SELECT * FROM (VALUES {', '.join(f'({x[0]})' if len(x) == 1 else str(x) for x in rows)}) t({cols})").write_parquet(str(d / f"{name}.parquet"))
    return str(d)


@pytest.mark.parametrize("name", ["pagerank_20", "hits_authority", "closeness", "betweenness", "descendants"])
def test_whole_graph_against_sql(spark, folder, name):
    """The registered SQL, and that of the all-pairs queries, which is too slow for large tables."""
    sql = ALL_PAIRS.get(name) or catalog.ORACLE[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = {tuple(r) for r in catalog.QUERIES[name](spark, folder).collect()}
    want = set(con.execute(sql).fetchall())
    near = lambda rows: {r[0]: pytest.approx(r[1], abs=2e-7) if len(r) > 1 else None for r in rows}
    assert "/parts/5000" in {r[0] for r in got}
    assert {r[0]: r[1] if len(r) > 1 else None for r in got} == near(want)


def test_meeting_through_late_parts(spark, folder):
    """Suppliers 1 and 5 meet in part 201, which alone has edges to both."""
    for name in ("meeting_subgraph", "min_meeting_subgraph"):
        got = {r["path"] for r in catalog.QUERIES[name](spark, folder).collect()}
        assert "/parts/201" in got and any(p.endswith("/parts/201/__meta__/edges/out/link/suppliers/5") for p in got)
