"""Directed graphs over paths: edges (src, dst[, type]); the nodes are the ends of edges.

Neighbours are joins. Reachability, ranks and subgraphs of graphs up to LOCAL_EDGES edges (no
more than that are fetched) are computed from adjacency arrays; larger graphs take the same
rounds as joins, written out as they go.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylvan.functions import paths as P
from sylvan.functions.shipping import ship
from sylvan.operators.relation import Relation
from sylvan.operators.scan import seeds
from sylvan.sources.staging import cut

LOCAL_EDGES = 2_000_000
#: Classes, and links between them, that come to the driver: numbers of 20 and 24 bytes, no paths.
LOCAL_LINKS = 8_000_000
#: More seeds than this are matched with the graph's nodes before they come to the driver.
MANY_SEEDS = 100_000
DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 100


def edges_of(entries: DataFrame, user: str | None = None) -> DataFrame:
    """Live edge rows as (src, dst, type); with a user only those inside that user's tree."""
    rows = entries.where("deleted_at is null and kind = 'edge'").select(F.col("source_path").alias("src"), F.col("target_path").alias("dst"), F.col("edge_type").alias("type"))
    if user is not None:
        lead = f"/{user}/"
        rows = rows.where(F.col("src").startswith(lead) & F.col("dst").startswith(lead))
    return rows


def pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("path")).distinct()


def _seeds(edges: DataFrame, wanted: Iterable[str] | DataFrame | Relation) -> DataFrame:
    return seeds(edges, wanted).distinct()


def predecessors(edges: DataFrame, wanted: Iterable[str] | DataFrame | Relation) -> Relation:
    own = _seeds(edges, wanted)
    out = edges.join(own.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path")).distinct().join(own, "path", "left_anti")
    return Relation.by_path(out, "predecessors")


def successors(edges: DataFrame, wanted: Iterable[str] | DataFrame | Relation) -> Relation:
    own = _seeds(edges, wanted)
    out = edges.join(own.withColumnRenamed("path", "src"), "src", "left_semi").select(F.col("dst").alias("path")).distinct().join(own, "path", "left_anti")
    return Relation.by_path(out, "successors")


def reach(edges: DataFrame, start: DataFrame, most: int | None = None, how: str = "out") -> DataFrame:
    """(path, depth) of all that can be reached from (path), itself at depth 0; along edges (out), against them (in), or either way (both).

    Graphs of few edges are searched as arrays.
    """
    return _reach(cut(edges.select("src", "dst"), "edges"), start, most, how)


def _reach(one: DataFrame, start: DataFrame, most: int | None, how: str) -> DataFrame:
    """The same of edges that were cut."""
    g = fetched(one.select("src", "dst"))
    if g is None:
        return reach_joins(one.select("src", "dst"), start, most, how)
    src, dst = (g.src, g.dst) if how == "out" else (g.dst, g.src) if how == "in" else (np.concatenate([g.src, g.dst]), np.concatenate([g.dst, g.src]))
    begin, near = g.lists(src, dst)
    depth = np.full(g.n, -1, np.int32)
    # of the wanted paths only those in the graph come to the driver, at most as many as it has nodes
    own = start.join(nodes(one), "path", "left_semi") if start.count() > MANY_SEEDS else start
    level = g.numbers(own.select("path").toArrow().column(0).to_pylist())
    at = 0
    while len(level) and (most is None or at <= most):
        depth[level] = at
        to = np.unique(near[_ranges(begin[level], begin[level + 1])])
        level, at = to[depth[to] < 0], at + 1
    found = np.flatnonzero(depth >= 0)
    table = pa.table({"path": pa.array(g.paths[found].tolist(), pa.string()), "depth": pa.array(depth[found])})
    return one.sparkSession.createDataFrame(table, T.StructType([T.StructField("path", T.StringType()), T.StructField("depth", T.IntegerType())]))


def reach_joins(edges: DataFrame, start: DataFrame, most: int | None = None, how: str = "out") -> DataFrame:
    """The same over a graph of any size, whose table was cut; repeated edges do no harm.

    A frontier is joined with the edges until nothing is new; each round is written to the
    shared folder, so the plan stays short and an executor's loss costs one round.
    """
    ends = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[how]
    paths = edges.select("src").unionByName(edges.select(F.col("dst").alias("src"))).withColumnRenamed("src", "path")
    seen = cut(start.select("path").distinct().join(paths, "path", "left_semi").select("path", F.lit(0).alias("depth")), "reach")
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        met = [edges.join(frontier.select(F.col("path").alias(a)), a, "left_semi").select(F.col(b).alias("path")) for a, b in ends]
        new = met[0] if len(met) == 1 else met[0].unionByName(met[1])
        new = cut(new.distinct().join(seen.select("path"), "path", "left_anti").select("path", F.lit(depth).alias("depth")), "reach")
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
        if depth % 8 == 0:
            seen = cut(seen, "reach")
    return seen


def descendants(edges: DataFrame, wanted: Iterable[str] | DataFrame | Relation) -> Relation:
    return Relation.by_path(reach(edges, _seeds(edges, wanted)).where("depth > 0").select("path"), "descendants")


def ancestors(edges: DataFrame, wanted: Iterable[str] | DataFrame | Relation) -> Relation:
    return Relation.by_path(reach(edges, _seeds(edges, wanted), how="in").where("depth > 0").select("path"), "ancestors")


def both_ways(edges: DataFrame) -> DataFrame:
    return pairs(edges).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def typed(edges: DataFrame) -> DataFrame:
    """One type for each pair, the greatest by name."""
    kind = F.max("type") if "type" in edges.columns else F.lit("link")
    return edges.groupBy("src", "dst").agg(kind.alias("type"))


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(path, kind) of kept nodes and of the edges among them, as edge paths."""
    # the few rows between kept nodes are found before they are grouped
    inner = typed(edges.join(kept.select(F.col("path").alias("src")), "src", "left_semi").join(kept.select(F.col("path").alias("dst")), "dst", "left_semi"))
    return kept.select("path", P.kind_col(F.col("path")).alias("kind")).unionByName(inner.select(P.edge_out_col(F.col("src"), F.col("dst"), F.col("type")).alias("path"), F.lit("edge").alias("kind")))


def neighborhood(edges: DataFrame, wanted: Iterable[str] | DataFrame | Relation, depth: int = 2) -> Relation:
    one = cut(edges, "edges")
    kept = _reach(one, _seeds(edges, wanted), depth, "both").select("path")
    return Relation.by_path(induced(one, kept), "neighborhood")


def degrees(edges: DataFrame) -> DataFrame:
    """(path, in_degree, out_degree) over distinct pairs, in one pass."""
    one = pairs(edges)
    ends = one.select(F.explode(F.array(F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    return ends.groupBy("path").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def degree_centrality(edges: DataFrame, which: str = "both") -> Relation:
    d = degrees(edges)
    n = d.agg(F.count("*").alias("n"))
    value = {"both": F.col("in_degree") + F.col("out_degree"), "in": F.col("in_degree"), "out": F.col("out_degree")}[which]
    rows = d.crossJoin(F.broadcast(n))  # one row
    return Relation.by_path(rows.select("path", F.when(F.col("n") > 1, value / (F.col("n") - 1)).otherwise(0.0).alias("score"), "in_degree", "out_degree"), {"both": "degree_centrality", "in": "in_degree_centrality", "out": "out_degree_centrality"}[which]).sort()


class Adjacency:
    """A graph of bounded size as arrays; nodes are numbered in path order."""

    def __init__(self, edges: pa.Table):
        ends = pa.chunked_array([*edges.column("src").chunks, *edges.column("dst").chunks], pa.string()).combine_chunks().dictionary_encode()
        ends = ends.combine_chunks() if isinstance(ends, pa.ChunkedArray) else ends
        names = np.array(ends.dictionary.to_pylist(), dtype=object).astype(str) if len(ends) else np.empty(0, str)
        by = np.argsort(names)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        codes = place[ends.indices.to_numpy()] if len(ends) else np.empty(0, np.int64)
        self.paths, m = names[by], len(edges)
        self.src, self.dst = codes[:m], codes[m:]
        self.n = len(self.paths)

    def numbers(self, paths: Iterable[str]) -> np.ndarray:
        """Nodes of those of the paths that the graph has."""
        wanted = np.array(sorted(set(paths)), dtype=object).astype(str)
        at = np.minimum(np.searchsorted(self.paths, wanted), max(0, self.n - 1))
        return at[self.paths[at] == wanted] if self.n and len(wanted) else np.empty(0, np.int64)

    def lists(self, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and neighbours of each node."""
        by = np.lexsort((dst, src))
        return np.searchsorted(src[by], np.arange(self.n + 1)), dst[by]


def local(edges: DataFrame) -> Adjacency | None:
    """The graph on the driver, where its edges are few enough; None otherwise."""
    return fetched(cut(pairs(edges), "edges"))


def fetched(one: DataFrame) -> Adjacency | None:
    """The same of a table that was cut: counted first, as a limit would gather up to that many rows of every part in one task."""
    return Adjacency(one.toArrow()) if one.count() <= LOCAL_EDGES else None


@dataclass(frozen=True)
class Twins:
    """A graph whose nodes are put together where the same nodes point to them: these are reached alike, and rank alike.

    An edge to one of a class goes along with edges to all of it, so a class has weights of
    links from other classes. The table of classes and links is far smaller than the graph
    where many nodes hang on few.
    """

    #: (path, cls, in_degree, out_degree)
    nodes: DataFrame
    #: (src, cls, to): an edge to a class, with the source's own.
    out: DataFrame
    #: By class: its nodes, and those of them without successors.
    size: np.ndarray
    loose: np.ndarray
    #: By link: classes at its ends, in this order; nodes of the first that point to any one of the second; the sum of 1 / out-degree of these.
    own: np.ndarray
    to: np.ndarray
    weight: np.ndarray
    share: np.ndarray

    def scored(self, scores: DataFrame, edges: DataFrame, function: str, candidates: Iterable[str] | DataFrame | Relation | None) -> Relation:
        rows = scores.select("path", "score", "in_degree", "out_degree")
        if candidates is not None:
            rows = rows.join(_seeds(edges, candidates), "path", "left_semi")
        return Relation.by_path(rows, function).sort()


def twins(edges: DataFrame, loops: bool = True) -> Twins | None:
    """The classes of a graph of distinct edges, whose table was cut; found by 128-bit hashes of the sets of predecessors. None where classes or links are too many for arrays. Without loops, edges of nodes to themselves count in degrees alone."""
    one = edges.select("src", "dst")
    own = F.lit(True) if loops else F.col("src") != F.col("dst")
    mark = lambda *x: F.when(own, F.xxhash64(*x, "src"))
    into = F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o"), mark().alias("a"), mark(F.lit("twins")).alias("b"))
    from_ = F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    ends = one.select(F.explode(F.array(into, from_)).alias("x")).select("x.*").groupBy("path")
    table = cut(ends.agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.coalesce(F.bit_xor("a"), F.lit(0)).alias("a"), F.coalesce(F.bit_xor("b"), F.lit(0)).alias("b"), F.count("a").alias("m")), "nodes")
    key = ["a", "b", "m"]
    kinds = cut(table.groupBy(*key).agg(F.min("path").alias("first"), F.count("*").alias("size"), F.sum((F.col("out_degree") == 0).cast("long")).alias("loose")).withColumn("part", F.pmod(F.hash("b"), F.lit(64))), "classes")
    counts = np.zeros(64, np.int64)
    for part, n in kinds.groupBy("part").count().collect():
        counts[part] = n
    k = int(counts.sum())
    if k > LOCAL_LINKS:
        return None
    before = F.array(*(F.lit(int(x)) for x in np.cumsum(counts) - counts))
    kinds = cut(kinds.withColumn("cls", (before[F.col("part")] + F.row_number().over(Window.partitionBy("part").orderBy(*key)) - 1).cast("int")), "classes")
    named = cut(table.join(kinds.select(*key, "cls"), key).select("path", "cls", "in_degree", "out_degree"), "nodes")
    to = one.where(own).join(kinds.select(F.col("first").alias("dst"), F.col("cls").alias("to")), "dst").select("src", "to")
    out = cut(to.join(named.select(F.col("path").alias("src"), "cls", "out_degree"), "src").select("src", "cls", "to", "out_degree"), "links")
    links = cut(out.groupBy("cls", "to").agg(F.count("*").cast("double").alias("weight"), F.sum(1 / F.col("out_degree")).alias("share")), "links")
    if links.count() > LOCAL_LINKS:
        return None
    c, e = kinds.select("cls", "size", "loose").toArrow().sort_by("cls"), links.toArrow().sort_by([("cls", "ascending"), ("to", "ascending")])
    size, loose = c.column("size").to_numpy(), c.column("loose").to_numpy()
    return Twins(named, out.select("src", "cls", "to"), size, loose, *(e.column(x).to_numpy() for x in ("cls", "to", "weight", "share")))


def _of_classes(spark: SparkSession, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"cls": pa.array(np.arange(len(values)), pa.int32()), "score": pa.array(values.astype(float))}), "cls int, score double")


def _scored(edges: DataFrame, scores: DataFrame, function: str, candidates: Iterable[str] | DataFrame | Relation | None) -> Relation:
    rows = scores.join(degrees(edges), "path")
    if candidates is not None:
        rows = rows.join(_seeds(edges, candidates), "path", "left_semi")
    return Relation.by_path(rows, function).sort()


def _frame(edges: DataFrame, g: Adjacency, values: np.ndarray) -> DataFrame:
    return edges.sparkSession.createDataFrame(pd.DataFrame({"path": g.paths.astype(object), "score": values.astype(float)}), "path string, score double")


def pagerank(edges: DataFrame, candidates: Iterable[str] | DataFrame | Relation | None = None, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE) -> Relation:
    """Ranks over the whole graph; rank of nodes without successors is spread evenly. Candidates only filter what is returned."""
    one = cut(pairs(edges), "edges")
    g = fetched(one)
    if g is not None:
        return _scored(one, _frame(edges, g, pagerank_arrays(g, rounds, tolerance)), "pagerank", candidates)
    t = twins(one)
    if t is not None:
        scores = _of_classes(edges.sparkSession, pagerank_twins(t, rounds, tolerance))
        return t.scored(t.nodes.join(scores, "cls"), one, "pagerank", candidates)
    return _scored(one, pagerank_joins(one, rounds, tolerance), "pagerank", candidates)


def pagerank_twins(t: Twins, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE) -> np.ndarray:
    """Ranks by class: what points to a node is all that its rank depends on."""
    n, k = t.size.sum(), len(t.size)
    rank = np.full(k, 1 / max(1, n))
    for _ in range(rounds if n else 0):
        new = (1 - DAMPING) / n + DAMPING * (np.bincount(t.to, rank[t.own] * t.share, k) + (rank * t.loose).sum() / n)
        done = tolerance is not None and (np.abs(new - rank) * t.size).sum() < tolerance * n
        rank = new
        if done:
            break
    return rank


def pagerank_arrays(g: Adjacency, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE) -> np.ndarray:
    out = np.bincount(g.src, minlength=g.n)
    rank = np.full(g.n, 1 / max(1, g.n))
    for _ in range(rounds if g.n else 0):
        share = np.divide(rank, out, out=np.zeros(g.n), where=out > 0)
        new = (1 - DAMPING) / g.n + DAMPING * (np.bincount(g.dst, share[g.src], g.n) + rank[out == 0].sum() / g.n)
        done = tolerance is not None and np.abs(new - rank).sum() < tolerance * g.n
        rank = new
        if done:
            break
    return rank


def pagerank_joins(edges: DataFrame, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE) -> DataFrame:
    one = cut(pairs(edges), "edges")
    out = cut(degrees(one).select("path", "out_degree"), "degrees")
    n = out.count()
    if not n:
        return out.select("path", F.lit(0.0).alias("score"))
    rank = cut(out.withColumn("rank", F.lit(1 / n)), "rank")
    for _ in range(rounds):
        loose = rank.where("out_degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        sent = one.join(rank.where("out_degree > 0").select(F.col("path").alias("src"), (F.col("rank") / F.col("out_degree")).alias("share")), "src").groupBy(F.col("dst").alias("path")).agg(F.sum("share").alias("got"))
        new = rank.select("path", "out_degree", F.col("rank").alias("was")).join(sent, "path", "left").select("path", "out_degree", "was", ((1 - DAMPING) / n + DAMPING * (F.coalesce("got", F.lit(0.0)) + loose / n)).alias("rank"))
        rank = cut(new, "rank")
        if tolerance is not None and rank.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < tolerance * n:
            break
    return rank.select("path", F.col("rank").alias("score"))


def hits(edges: DataFrame, which: str = "authority", candidates: Iterable[str] | DataFrame | Relation | None = None, rounds: int = 1000, tolerance: float | None = 1e-8) -> Relation:
    """Hub or authority scores, each summing to 1."""
    if which not in ("authority", "hub"):
        raise ValueError("score must be 'authority' or 'hub'")
    one = cut(pairs(edges), "edges")
    g = fetched(one)
    if g is not None:
        return _scored(one, _frame(edges, g, hits_arrays(g, which, rounds, tolerance)), "hits", candidates)
    # hub scores, and how far they move, are of nodes and not of classes
    t = twins(one) if which == "authority" and tolerance is None else None
    if t is not None:
        return t.scored(t.nodes.join(_of_classes(edges.sparkSession, authority_twins(t, rounds)), "cls"), one, "hits", candidates)
    return _scored(one, hits_joins(one, which, rounds, tolerance), "hits", candidates)


def authority_twins(t: Twins, rounds: int) -> np.ndarray:
    """Authority by class, summing to 1 over the nodes.

    A round is one pass over blocks of edges that hold all of a node's successors: its hub
    score follows from the authorities of the round before and goes on to the next ones.
    """
    spark, k, size = t.out.sparkSession, len(t.size), t.size.astype(float)
    ship(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = [batch.column("to") for batch in batches if len(batch)]
        if lists:
            length = np.concatenate([x.value_lengths().to_numpy() for x in lists])
            to = np.concatenate([x.flatten().to_numpy() for x in lists]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([length.astype(np.int32).tobytes()], pa.binary()), pa.array([to.tobytes()], pa.binary())], ["length", "to"])

    blocks = cut(t.out.groupBy("src").agg(F.collect_list("to").alias("to")).select("to").mapInArrow(pack, "length binary, to binary"), "blocks")
    blocks = blocks.coalesce(max(1, spark.sparkContext.defaultParallelism))

    def passed(given: np.ndarray | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for batch in batches:
                for a, b in zip(batch.column("length"), batch.column("to")):
                    length, to = np.frombuffer(a.as_py(), np.int32), np.frombuffer(b.as_py(), np.int32)
                    hub = np.ones(len(length)) if given is None else np.add.reduceat(given[to], np.cumsum(length) - length)
                    total += np.bincount(to, np.repeat(hub, length), k)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

        return sum((np.frombuffer(row["total"]) for row in blocks.mapInArrow(run, "total binary").collect()), np.zeros(k))

    auth = np.zeros(k)
    for r in range(rounds):
        auth = passed(auth * size if r else None)
        auth /= (auth * size).sum() or 1.0
    return auth


def hits_arrays(g: Adjacency, which: str, rounds: int, tolerance: float | None) -> np.ndarray:
    hub = np.full(g.n, 1 / max(1, g.n))
    auth = np.zeros(g.n)
    for _ in range(rounds if g.n else 0):
        auth = np.bincount(g.dst, hub[g.src], g.n)
        new = np.bincount(g.src, auth[g.dst], g.n)
        new /= new.max()
        done = tolerance is not None and np.abs(new - hub).sum() < tolerance
        hub = new
        if done:
            break
    x = auth if which == "authority" else hub
    return x / x.sum() if g.n else x


def hits_joins(edges: DataFrame, which: str, rounds: int, tolerance: float | None) -> DataFrame:
    one = cut(pairs(edges), "edges")
    hub = cut(nodes(one).withColumn("h", F.lit(1.0)), "hub")
    auth = hub
    for _ in range(rounds):
        auth = cut(one.join(hub.select(F.col("path").alias("src"), "h"), "src").groupBy(F.col("dst").alias("path")).agg(F.sum("h").alias("a")), "authority")
        raw = one.join(auth.select(F.col("path").alias("dst"), "a"), "dst").groupBy(F.col("src").alias("path")).agg(F.sum("a").alias("r"))
        raw = cut(hub.select("path", F.col("h").alias("was")).join(raw, "path", "left").select("path", "was", F.coalesce("r", F.lit(0.0)).alias("r")), "hub")
        peak = raw.agg(F.max("r")).first()[0]
        if not peak:
            break
        hub = raw.select("path", (F.col("r") / peak).alias("h"))
        if tolerance is not None and raw.agg(F.sum(F.abs(F.col("r") / peak - F.col("was")))).first()[0] < tolerance:
            break
    own = auth.select("path", F.col("a").alias("x")) if which == "authority" else hub.select("path", F.col("h").alias("x"))
    total = own.agg(F.sum("x").alias("t"))
    return nodes(one).join(own, "path", "left").crossJoin(F.broadcast(total)).select("path", F.coalesce(F.col("x") / F.col("t"), F.lit(0.0)).alias("score"))


def _sources(t: Twins) -> DataFrame:
    """(path, cls, to): every node with successors and the classes it points to, spread over tasks."""
    spark = t.out.sparkSession
    ship(spark)
    rows = t.out.groupBy(F.col("src").alias("path")).agg(F.first("cls").alias("cls"), F.collect_list("to").alias("to"))
    return cut(rows, "sources").repartition(max(1, min(spark.sparkContext.defaultParallelism * 4, int(t.size.sum()) // 64)))


def _lists(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of sources: their classes, and where their lists start in the last."""
    column = batch.column("to")
    return batch.column("cls").to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]), column.flatten().to_numpy()


def betweenness_centrality(edges: DataFrame, candidates: Iterable[str] | DataFrame | Relation | None = None) -> Relation:
    """Shares of shortest directed paths through a node, over (n - 1)(n - 2). Every source is searched over the classes of the graph."""
    one = cut(pairs(edges), "edges")
    t = twins(one, loops=False)
    if t is None:
        return _scored(one, betweenness_joins(one), "betweenness_centrality", candidates)
    n, k, size, own, to, weight = int(t.size.sum()), len(t.size), t.size, t.own, t.to, t.weight
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    width = max(1, min(32, 8_000_000 // max(1, k + len(to))))
    begin = np.searchsorted(own, np.arange(k + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(to))
        for batch in batches:
            cls, at, lists = _lists(batch)
            for j in range(0, len(cls), width):
                end = min(j + width, len(cls))
                total += _shares(begin, to, weight, size, cls[j:end], at[j : end + 1] - at[j], lists[at[j] : at[end]])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own[some], pa.int32()), pa.array(to[some], pa.int32()), pa.array(total[some])], ["cls", "to", "value"])

    through = _sources(t).mapInArrow(run, "cls int, to int, value double").groupBy("cls", "to").agg(F.sum("value").alias("value"))
    summed = t.out.join(through, ["cls", "to"]).groupBy(F.col("src").alias("path")).agg((F.sum("value") * scale).alias("score"))
    return t.scored(t.nodes.join(summed, "path", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), one, "betweenness_centrality", candidates)


def _shares(begin: np.ndarray, to: np.ndarray, weight: np.ndarray, size: np.ndarray, cls: np.ndarray, at: np.ndarray, lists: np.ndarray) -> np.ndarray:
    """By link, what a node of its first class has of shortest paths over it, from these sources, which are searched together, a column each.

    A source is apart from its class, whose others are reached as any node is. What it
    points to has distance 1, so no link that leaves its class with its own edge counts.
    """
    k, b = len(size), len(cls)
    column = np.repeat(np.arange(b), np.diff(at))
    dist, count = np.full((k, b), -1, np.int16), np.zeros((k, b))
    dist[lists, column], count[lists, column] = 1, 1
    steps, level, depth = [], np.unique(lists), 1
    while len(level):
        e, own = _ranges(begin[level], begin[level + 1]), np.repeat(level, begin[level + 1] - begin[level])
        depth += 1
        open_ = (dist[to[e]] < 0).any(1) if len(e) else np.empty(0, bool)
        e, own = e[open_], own[open_]
        if not len(e):
            break
        by = np.argsort(to[e], kind="stable")
        e, own = e[by], own[by]
        reached = to[e]
        first = np.flatnonzero(np.concatenate([[True], reached[1:] != reached[:-1]]))
        sent = np.add.reduceat(np.where(dist[own] == depth - 1, count[own] * weight[e][:, None], 0.0), first)
        reached = reached[first]
        fresh = (dist[reached] < 0) & (sent > 0)
        dist[reached] = np.where(fresh, depth, dist[reached])
        count[reached] = np.where(fresh, sent, count[reached])
        level = reached[fresh.any(1)]
        steps.append((own, e))
    part, total = np.zeros((k, b)), np.zeros(len(to))
    part[cls, np.arange(b)] = -1  # the source is no end of its own paths
    for depth in range(len(steps), 0, -1):
        own, e = steps[depth - 1]
        by = np.argsort(own, kind="stable")
        e, own = e[by], own[by]
        on = (dist[own] == depth) & (dist[to[e]] == depth + 1)
        value = np.where(on, count[own] / np.maximum(count[to[e]], 1) * (size[to[e]][:, None] + part[to[e]]), 0.0)
        total[e] += value.sum(1)
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        part[own[first]] += np.add.reduceat(value * weight[e][:, None], first)
    return total


def _ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All numbers of the ranges a[i] to b[i], one after another."""
    n = b - a
    return np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def all_distances(edges: DataFrame) -> DataFrame:
    """(root, path, dist, paths): shortest distances from every node and the numbers of shortest paths, level by level."""
    one = cut(pairs(edges), "edges")
    seen = cut(nodes(one).select(F.col("path").alias("root"), "path", F.lit(0).alias("dist"), F.lit(1.0).alias("paths")), "distances")
    frontier, depth = seen, 0
    while True:
        depth += 1
        new = frontier.select("root", F.col("path").alias("src"), "paths").join(one, "src").groupBy("root", F.col("dst").alias("path")).agg(F.sum("paths").alias("paths"))
        new = cut(new.join(seen, ["root", "path"], "left_anti").select("root", "path", F.lit(depth).alias("dist"), "paths"), "distances")
        if new.isEmpty():
            return seen
        seen, frontier = seen.unionByName(new), new


def betweenness_joins(edges: DataFrame) -> DataFrame:
    one, d = cut(pairs(edges), "edges"), cut(all_distances(edges), "distances")
    n, deepest = nodes(one).count(), d.agg(F.max("dist")).first()[0] or 0
    part = d.select("root", "path", "dist", "paths", F.lit(0.0).alias("part")).where(F.col("dist") == deepest)
    done = [part]
    for level in range(deepest - 1, -1, -1):
        below = part.select("root", F.col("path").alias("dst"), (F.col("part") + 1).alias("up"), F.col("paths").alias("below"))
        own = d.where(F.col("dist") == level)
        sent = own.select("root", F.col("path").alias("src"), "paths").join(one, "src").join(below, ["root", "dst"]).groupBy("root", F.col("src").alias("path")).agg(F.sum(F.col("paths") / F.col("below") * F.col("up")).alias("part"))
        part = cut(own.join(sent, ["root", "path"], "left").select("root", "path", "dist", "paths", F.coalesce("part", F.lit(0.0)).alias("part")), "parts")
        done.append(part)
    rows = done[0]
    for x in done[1:]:
        rows = rows.unionByName(x)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return rows.where("root <> path").groupBy("path").agg((F.sum("part") * scale).alias("score")).join(nodes(one), "path", "right").select("path", F.coalesce("score", F.lit(0.0)).alias("score"))


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, in order."""
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
    return a[new], b[new]


def _groups(t: Twins) -> np.ndarray:
    """A number by class, the same where the same classes point to them: 128-bit sums of these are compared."""
    k = len(t.size)
    by = np.argsort(t.to, kind="stable")
    to, sums = t.to[by], np.zeros((2, k), np.uint64)
    if len(to):
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        for row, marks in zip(sums, np.random.default_rng(1).integers(0, 2**64, (2, k), np.uint64)):
            row[to[first]] = np.add.reduceat(marks[t.own[by]], first)
    order = np.lexsort(sums)
    group = np.empty(k, np.int64)
    group[order] = np.cumsum((np.diff(sums[:, order], axis=1, prepend=sums[:, order[:1]]) != 0).any(0))
    return group


def closeness_centrality(edges: DataFrame, candidates: Iterable[str] | DataFrame | Relation | None = None) -> Relation:
    """(reaching - 1) / sum of distances to the node, times (reaching - 1) / (n - 1).

    A class is as far from a source for all its nodes but the source itself, so each class
    has sums, from which a node's way back to itself is taken. Classes that the same classes
    point to (a group) are as far from all sources but those that point to them: a source is
    searched over groups, and its own edges are set right one by one. 64 sources share a word.
    """
    one = cut(pairs(edges), "edges")
    t = twins(one, loops=False)
    if t is None:
        d = all_distances(one)
        n = nodes(one).count()
        got = d.groupBy("path").agg(F.count("*").alias("k"), F.sum("dist").alias("far"))
        return _scored(one, got.select("path", F.when(F.col("far") > 0, (F.col("k") - 1) / F.col("far") * (F.col("k") - 1) / (n - 1)).otherwise(0.0).alias("score")), "closeness_centrality", candidates)
    n, k = int(t.size.sum()), len(t.size)
    group = _groups(t)
    g = int(group.max(initial=-1)) + 1
    # groups whose nodes are reached in two steps over a class, by class; groups that hold what points to a group
    over, far_on = _distinct(t.own, group[t.to])
    begin = np.searchsorted(over, np.arange(k + 1))
    rows, own = _distinct(group[t.to], group[t.own])
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.empty(0, int)
    rows = rows[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, reached = np.zeros(k, np.int64), np.zeros(k, np.int64)
        far_group, reached_group = np.zeros(g, np.int64), np.zeros(g, np.int64)
        for batch in batches:
            cls, at, lists = _lists(batch)
            back = np.zeros(len(cls), np.int64)
            for j in range(0, len(cls), 64):
                some = cls[j : j + 64]
                bit = np.uint64(1) << np.arange(len(some), dtype=np.uint64)
                near = lists[at[j] : at[j + len(some)]]
                bits = np.repeat(bit, np.diff(at[j : j + len(some) + 1]))
                met, place = np.unique(near, return_inverse=True)
                share = np.zeros(len(met), np.uint64)
                np.bitwise_or.at(share, place, bits)
                level = np.zeros(g, np.uint64)
                np.bitwise_or.at(level, far_on[_ranges(begin[met], begin[met + 1])], np.repeat(share, begin[met + 1] - begin[met]))
                seen, depth, to, mine = level.copy(), 1, group[near], group[some]
                around = np.zeros(len(near), np.int64)
                while level.any():
                    new = np.bitwise_count(level).astype(np.int64)
                    far_group, reached_group = far_group + (depth + 1) * new, reached_group + new
                    around += np.where(level[to] & bits, depth + 1, 0)
                    back[j : j + len(some)] += np.where(level[mine] & bit, depth + 1, 0)
                    after = np.zeros(g, np.uint64)
                    if len(first):
                        after[rows] = np.bitwise_or.reduceat(level[own], first)
                    level = after & ~seen
                    seen |= level
                    depth += 1
                # what a source points to is 1 away, whatever its group has
                np.add.at(far, near, 1 - around)
                np.add.at(reached, near, (around == 0).astype(np.int64))
            yield out(batch.column("path"), cls, back, np.zeros(len(cls), np.int64))
        yield out(pa.nulls(k, pa.string()), np.arange(k), far + far_group[group], reached + reached_group[group])

    def out(path, cls, far, reached):
        return pa.RecordBatch.from_arrays([path, pa.array(cls, pa.int32()), pa.array(far, pa.int64()), pa.array(reached, pa.int64())], ["path", "cls", "far", "reached"])

    found = cut(_sources(t).mapInArrow(run, "path string, cls int, far long, reached long"), "distances")
    sums = found.where("path is null").groupBy("cls").agg(F.sum("far").alias("far"), F.sum("reached").alias("reached"))
    back = found.where("path is not null").select("path", F.col("far").alias("back"))
    own_back = F.coalesce("back", F.lit(0))
    far, others = F.col("far") - own_back, F.col("reached") - F.when(own_back > 0, 1).otherwise(0)
    score = F.coalesce(F.when(far > 0, others / far * others / (n - 1)), F.lit(0.0))
    return t.scored(t.nodes.join(sums, "cls", "left").join(back, "path", "left").withColumn("score", score), one, "closeness_centrality", candidates)


def meeting_subgraph(edges: DataFrame, wanted: Iterable[str] | DataFrame | Relation, minimal: bool = False) -> Relation:
    """Nodes and edges that connect the seeds, found by searching from all of them at once.

    Levels are taken in path order, so ties have one outcome. Nodes that aren't seeds are
    dropped while they lack an edge in or out among the kept. ``minimal`` also drops, the
    smallest path first, what isn't needed to keep the rest connected. Larger graphs are
    first narrowed to the undirected neighbourhood in which the seeds meet.
    """
    own = _seeds(edges, wanted)
    one = cut(pairs(edges), "edges")
    g = fetched(one)
    depth, before = 1, -1
    while g is None:
        near = reach_joins(one, own, depth, "both").select("path")
        inner = one.join(near.withColumnRenamed("path", "src"), "src", "left_semi").join(near.withColumnRenamed("path", "dst"), "dst", "left_semi")
        some = local(inner)
        if some is None:
            raise ValueError("the seeds' neighbourhood is larger than the bound for subgraphs")
        # until the seeds are connected or nothing more can be reached from them
        if some.n == before or _connected(some, [r[0] for r in own.collect()]):
            g = some
        depth, before = depth * 2, some.n
    at = {p: k for k, p in enumerate(g.paths.tolist())}
    start = sorted(at[r[0]] for r in own.collect() if r[0] in at)
    name = "min_meeting_subgraph" if minimal else "meeting_subgraph"
    kept = set(start) if len(start) < 2 else _meet(g, start)
    if minimal and len(start) > 1:
        kept = _shrink(g, kept, set(start))
    spark = edges.sparkSession
    rows = spark.createDataFrame([(str(g.paths[k]),) for k in sorted(kept)], "path string")
    return Relation.by_path(rows if len(start) < 2 else induced(edges, rows), name)


def _near(g: Adjacency) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(g.n)]
    for a, b in zip(g.src.tolist(), g.dst.tolist()):
        if a != b:
            out[a].append(b)
            out[b].append(a)
    return [sorted(set(x)) for x in out]


def _connected(g: Adjacency, wanted: list[str]) -> bool:
    at = {p: k for k, p in enumerate(g.paths.tolist())}
    start = [at[p] for p in wanted if p in at]
    if not start:
        return True
    near, seen, queue = _near(g), {start[0]}, deque(start[:1])
    while queue:
        for y in near[queue.popleft()]:
            if y not in seen:
                seen.add(y)
                queue.append(y)
    return all(s in seen for s in start)


def _meet(g: Adjacency, start: list[int]) -> set[int]:
    near = _near(g)
    owner, via = {s: s for s in start}, {s: s for s in start}
    group = {s: s for s in start}

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    left, queue, bridges = len(start), deque(start), []
    while queue and left > 1:
        x = queue.popleft()
        for y in near[x]:
            if y not in owner:
                owner[y], via[y] = owner[x], x
                queue.append(y)
            elif (a := find(owner[y])) != (b := find(owner[x])):
                bridges.append((x, y))
                group[max(a, b)] = min(a, b)
                left -= 1
    kept = set(start)
    for pair in bridges:
        for x in pair:
            while x not in kept or via[x] != x:
                kept.add(x)
                if via[x] == x:
                    break
                x = via[x]
    return _strip(g, kept, set(start))


def _strip(g: Adjacency, kept: set[int], fixed: set[int]) -> set[int]:
    kept = set(kept)
    out: dict[int, set[int]] = {k: set() for k in kept}
    into: dict[int, set[int]] = {k: set() for k in kept}
    for a, b in zip(g.src.tolist(), g.dst.tolist()):
        if a in kept and b in kept:
            out[a].add(b)
            into[b].add(a)
    todo = [k for k in kept - fixed if not out[k] or not into[k]]
    while todo:
        x = todo.pop()
        if x not in kept:
            continue
        kept.discard(x)
        for y in out[x]:
            into[y].discard(x)
        for y in into[x]:
            out[y].discard(x)
        todo += [y for y in (out[x] | into[x]) & kept - fixed if not out[y] or not into[y]]
    return kept


def _shrink(g: Adjacency, kept: set[int], fixed: set[int]) -> set[int]:
    """Drops the smallest node that isn't fixed and whose loss splits no part, until none is left."""
    near = _near(g)
    kept = set(kept)

    def parts(inside: set[int]) -> int:
        n, rest = 0, set(inside)
        while rest:
            n += 1
            stack = [rest.pop()]
            while stack:
                for y in near[stack.pop()]:
                    if y in rest:
                        rest.discard(y)
                        stack.append(y)
        return n

    while True:
        now = parts(kept)
        gone = next((x for x in sorted(kept - fixed) if parts(kept - {x}) <= now), None)
        if gone is None:
            return kept
        kept.discard(gone)


class Graph:
    """A graph value with the mutations that return a new one."""

    def __init__(self, edges: DataFrame, lone: DataFrame | None = None):
        self.edges = typed(edges)
        self.lone = lone if lone is not None else edges.sparkSession.createDataFrame([], "path string")

    def nodes(self) -> DataFrame:
        return nodes(self.edges).unionByName(self.lone).distinct()

    def has_node(self, path: str) -> bool:
        return not self.nodes().where(F.col("path") == path).isEmpty()

    def has_edge(self, src: str, dst: str) -> bool:
        return not self.edges.where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()

    def add_node(self, path: str) -> Graph:
        spark = self.edges.sparkSession
        return Graph(self.edges, self.lone.unionByName(spark.createDataFrame([(path,)], "path string")).distinct())

    def add_edge(self, src: str, dst: str, type: str) -> Graph:
        row = self.edges.sparkSession.createDataFrame([(src, dst, type)], "src string, dst string, type string")
        return Graph(self.edges.where(~((F.col("src") == src) & (F.col("dst") == dst))).unionByName(row), self.lone)

    def remove_node(self, path: str) -> Graph:
        kept = self.nodes().where(F.col("path") != path)
        return Graph(self.edges.where((F.col("src") != path) & (F.col("dst") != path)), kept)

    def remove_edge(self, src: str, dst: str) -> Graph:
        return Graph(self.edges.where(~((F.col("src") == src) & (F.col("dst") == dst))), self.nodes())
