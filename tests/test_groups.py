"""What keeps searches and ranks linear where classes of nodes grow with the graph."""

import random

import pytest

from sylvan.operators import graph as Gr

from test_twins import plain


def ring(parts, suppliers, seed=7):
    """Parts that hang on regions, suppliers of all of them, nations, regions; a loop and nodes that few reach."""
    r = random.Random(seed)
    edges = {(f"p{k}", f"s{x}") for k in range(parts) for x in r.sample(range(suppliers), 6)} | {(f"s{k}", f"n{k % 5}") for k in range(suppliers)}
    edges |= {(f"n{k}", f"r{k % 2}") for k in range(5)} | {(f"r{k % 2}", f"p{k}") for k in range(parts - 3)}
    return sorted(edges | {("p0", "p0"), ("v", "s0"), ("s1", "w"), ("w", "v"), ("x", "y"), ("y", "x")})


def value(rel):
    return {x["path"]: x["score"] for x in rel.df.collect()}


def test_closeness_searches_groups_of_classes(spark):
    """Each supplier is a class of its own, but what is searched doesn't grow with them."""
    sizes = []
    for suppliers in (30, 60):
        edges = ring(80, suppliers)
        df = spark.createDataFrame(edges, "src string, dst string")
        t = Gr.twins(df, loops=False)
        assert len(t.size) > suppliers
        sizes.append(Gr._groups(t).max() + 1)
        assert value(Gr.closeness_centrality(df)) == pytest.approx(plain(edges)[1])
    assert sizes[1] < sizes[0] + 10


def test_classes_are_not_bounded_by_edges(spark, monkeypatch):
    """Links between classes are numbers: more of them are held than edges of paths, before joins take over."""
    edges = ring(40, 20)
    df = spark.createDataFrame(edges, "src string, dst string")
    near, ranks = plain(edges)[1], value(Gr.pagerank(df, rounds=20, tolerance=None))

    def no(*_):
        raise AssertionError("joined round by round")

    monkeypatch.setattr(Gr, "LOCAL_EDGES", 50)
    monkeypatch.setattr(Gr, "all_distances", no)
    monkeypatch.setattr(Gr, "pagerank_joins", no)
    assert value(Gr.closeness_centrality(df)) == pytest.approx(near)
    assert value(Gr.pagerank(df, rounds=20, tolerance=None)) == pytest.approx(ranks)


def test_distinct_edges_are_written_once(spark, monkeypatch):
    """Ranks of large graphs sort and write their edges one time."""
    made, cut = [], Gr.cut

    def keep(df, name="cut"):
        made.append(name)
        return cut(df, name)

    monkeypatch.setattr(Gr, "cut", keep)
    monkeypatch.setattr(Gr, "LOCAL_EDGES", 50)
    Gr.pagerank(spark.createDataFrame(ring(40, 20), "src string, dst string"), rounds=2, tolerance=None)
    assert made.count("edges") == 1
