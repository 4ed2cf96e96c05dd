"""Graphs over classes of nodes that the same nodes point to, against plain searches."""

import random
from collections import defaultdict, deque

import pytest

from sylvan.operators import graph as Gr


def plain(edges):
    """Betweenness and closeness by a search from every node."""
    names, out = sorted({x for e in edges for x in e}), defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    between, far, met = ({v: 0 for v in names} for _ in range(3))
    for root in names:
        dist, count, before, queue, order = {root: 0}, {root: 1.0}, defaultdict(list), deque([root]), []
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in out[x]:
                if y not in dist:
                    dist[y], count[y] = dist[x] + 1, 0.0
                    queue.append(y)
                if dist[y] == dist[x] + 1:
                    count[y] += count[x]
                    before[y].append(x)
        part = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in before[y]:
                part[x] += count[x] / count[y] * (1 + part[y])
            between[y] += part[y] if y != root else 0
            far[y], met[y] = far[y] + dist[y], met[y] + 1
    n = len(names)
    return {v: x / (n - 1) / (n - 2) for v, x in between.items()}, {v: (met[v] - 1) ** 2 / far[v] / (n - 1) if far[v] else 0.0 for v in names}


def test_classes_against_searches(spark):
    r = random.Random(5)
    parts, places = [f"p{k}" for k in range(40)], [f"s{k}" for k in range(12)]
    edges = {(p, x) for p in parts for x in r.sample(places, r.randint(1, 5))} | {(x, r.choice(["n0", "n1", "n2"])) for x in places} | {("n0", "r0"), ("n1", "r1"), ("n2", "r0")}
    edges |= {(r.choice(["r0", "r1"]), p) for p in parts[:35]} | {("p1", "p1"), ("lone", "lone")} | {("v1", "y1"), ("v1", "y2"), ("y1", "v2")}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    value = lambda rel: {x["path"]: x["score"] for x in rel.df.collect()}
    between, near = plain(edges)
    assert value(Gr.betweenness_centrality(df)) == pytest.approx(between)
    assert value(Gr.closeness_centrality(df)) == pytest.approx(near)
    t, g = Gr.twins(df), Gr.local(df)
    assert len(t.size) < 30 and t.size.sum() == g.n
    ranks, want = Gr.pagerank_twins(t), dict(zip(g.paths.tolist(), Gr.pagerank_arrays(g)))
    assert {x["path"]: ranks[x["cls"]] for x in t.nodes.collect()} == pytest.approx(want)


def test_large_forms_equal_small_ones(spark, monkeypatch):
    """Above the bound edges are counted, not fetched up to a limit, and the joins and classes give the same."""
    r = random.Random(3)
    df = spark.createDataFrame(sorted({(f"/v{r.randint(0, 24)}", f"/v{r.randint(0, 24)}") for _ in range(40)} | {("/z", "/v1"), ("/z", "/v2"), ("/v3", "/y1"), ("/v3", "/y2"), ("/y1", "/v3")}), "src string, dst string")

    def results():
        found = [Gr.ancestors(df, ["/v3", "/no"]), Gr.neighborhood(df, ["/v3"])]
        return [sorted(x["path"] for x in rel.df.collect()) for rel in found], {x["path"]: x["score"] for x in Gr.hits(df, rounds=20, tolerance=None).df.collect()}

    small, scores = results()
    monkeypatch.setattr(Gr, "fetched", lambda one: None)
    large, others = results()
    assert small[0] and large == small and others == pytest.approx(scores)
