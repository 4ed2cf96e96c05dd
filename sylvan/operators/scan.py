"""Point reads, listings and path patterns over entries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.functions import paths as P
from sylvan.functions import patterns as G
from sylvan.operators.relation import Relation


def live(entries: DataFrame) -> DataFrame:
    return entries.where("deleted_at is null")


def seeds(entries: DataFrame, wanted: Iterable[str] | DataFrame | Relation) -> DataFrame:
    """(path) of what is asked for."""
    if isinstance(wanted, Relation):
        return wanted.df.select("path")
    if isinstance(wanted, DataFrame):
        return wanted.select("path")
    return entries.sparkSession.createDataFrame([(P.normalize(p),) for p in wanted], "path string").distinct()


#: Up to so many paths given as arguments become a filter that the scan takes; more of them are joined.
FEW_PATHS = 200


def at_paths(entries: DataFrame, wanted: Iterable[str] | DataFrame | Relation) -> DataFrame:
    """The rows at the paths that are asked for."""
    if not isinstance(wanted, (Relation, DataFrame)):
        wanted = [P.normalize(p) for p in wanted]
        if len(wanted) <= FEW_PATHS:
            return entries.where(F.col("path").isin(wanted))
    return entries.join(seeds(entries, wanted), "path", "left_semi")


def read(entries: DataFrame, wanted: Iterable[str] | DataFrame | Relation, columns: tuple[str, ...] = ("kind", "content", "size_bytes", "updated_at"), function: str = "read") -> Relation:
    return Relation.by_path(at_paths(live(entries), wanted).select("path", *columns), function)


def not_found(entries: DataFrame, wanted: Iterable[str] | DataFrame | Relation) -> DataFrame:
    """(path, error) of what isn't there."""
    return seeds(entries, wanted).join(live(entries).select("path"), "path", "left_anti").select("path", F.concat(F.lit("Not found: "), "path").alias("error"))


def stat(entries: DataFrame, wanted: Iterable[str] | DataFrame | Relation) -> Relation:
    return read(entries, wanted, ("kind", "size_bytes", "updated_at"), "stat")


def inverse_edges(edges: DataFrame) -> DataFrame:
    """(path, kind) of the incoming-edge view, with its directories; nothing of it is stored."""
    at = P.edge_in_col(F.col("src"), F.col("dst"), F.col("type"))
    own = edges.select(at.alias("path")).distinct().select("path", F.lit("edge").alias("kind"))
    base = F.concat(F.lit(P.META), F.col("dst"), F.lit(f"/{P.FRAME}/edges/in"))
    dirs = edges.select(F.explode(F.array(base, F.concat(base, F.lit("/"), "type"))).alias("path")).distinct().select("path", F.lit("directory").alias("kind"))
    return own.unionByName(dirs)


def ls(entries: DataFrame, wanted: Iterable[str] | DataFrame | Relation, edges: DataFrame | None = None) -> Relation:
    """Direct children; metadata shows only below /.meta."""
    parents = seeds(entries, wanted).withColumnRenamed("path", "parent_path")
    rows = live(entries).where(F.col("kind").isin("file", "directory") | F.col("parent_path").startswith(P.META)).select("path", "parent_path", "kind", "size_bytes", "updated_at")
    if edges is not None:
        view = inverse_edges(edges).withColumn("parent_path", P.parent_col(F.col("path")))
        rows = rows.unionByName(view, allowMissingColumns=True)
    return Relation.by_path(rows.where("path <> '/'").join(parents, "parent_path", "left_semi").drop("parent_path"), "ls")


def tree(entries: DataFrame, root: str = "/", depth: int | None = None, every: bool = False) -> Relation:
    """Everything below a directory, to a depth."""
    if depth is not None and depth < 1:
        raise ValueError("depth must be at least 1")
    root = P.normalize(root)
    lead = "/" if root == "/" else root + "/"
    rows = live(entries).where(F.col("path").startswith(lead) & (F.col("path") != "/"))
    if not every and not root.startswith(P.META):
        rows = rows.where(F.col("kind").isin("file", "directory") & ~F.col("path").startswith(P.META + "/"))
    if depth is not None:
        rows = rows.where(P.depth_col(F.col("path")) <= lead.count("/") + depth - 1)
    return Relation.by_path(rows.select("path", "kind", "size_bytes", "updated_at"), "tree")


def trees(entries: DataFrame, roots: DataFrame, depth: int | None = None, every: bool = False) -> Relation:
    """Everything below any of the directories (path), by equal joins on ancestors; a depth counts from each root."""
    if depth is not None and depth < 1:
        raise ValueError("depth must be at least 1")
    rows = live(entries).where("path <> '/'")
    if not every:
        rows = rows.where(F.col("kind").isin("file", "directory"))
    plain = F.col("path")
    ups = rows.select("path", F.explode(F.concat(F.array(F.lit("/")), P.ancestors_col(plain))).alias("root"))
    ups = ups.where(F.col("root") != F.col("path")).join(roots.select(F.col("path").alias("root")).distinct(), "root", "left_semi")
    if not every:
        ups = ups.where(F.col("root").startswith(P.META) | ~F.col("path").startswith(P.META + "/"))
    if depth is not None:
        ups = ups.where(P.depth_col(F.col("path")) - F.when(F.col("root") == "/", 0).otherwise(P.depth_col(F.col("root"))) <= depth)
    return Relation.by_path(rows.join(ups.select("path").distinct(), "path", "left_semi").select("path", "kind", "size_bytes", "updated_at"), "tree")


def structural(ext: Iterable[str] = (), ext_not: Iterable[str] = (), paths: Iterable[str] = (), globs: Iterable[str] = (), globs_not: Iterable[str] = (), keep_unknown: bool = False) -> Column:
    """The filters on path and extension as one Column; an entry without extension fails ext_not unless ``keep_unknown``."""
    test = F.lit(True)
    ext, ext_not, paths, globs, globs_not = (list(x) for x in (ext, ext_not, paths, globs, globs_not))
    own = F.col("ext")
    if ext:
        test &= own.isin(G.extensions_of(ext))
    if ext_not:
        out = ~own.isin(G.extensions_of(ext_not))
        test &= F.coalesce(out, F.lit(True)) if keep_unknown else out
    if paths:
        any_of = F.lit(False)
        for p in paths:
            any_of |= P.within_col(F.col("path"), P.normalize(p))
        test &= any_of
    if globs:
        any_of = F.lit(False)
        for g in globs:
            any_of |= G.glob_col(F.col("path"), g if g.startswith("/") else f"**/{g}")
        test &= any_of
    for g in globs_not:
        test &= ~G.glob_col(F.col("path"), g if g.startswith("/") else f"**/{g}")
    return test


def glob(entries: DataFrame, pattern: str, paths: Iterable[str] = (), ext: Iterable[str] = (), max_count: int | None = None, candidates: Relation | None = None) -> Relation:
    """Files and directories by path pattern. A literal prefix and an extension tail become comparisons that the scan takes."""
    paths = list(paths)
    prefix, tail, whole = G.glob_parts(pattern)
    if candidates is not None:
        rows = candidates.df.withColumn("ext", P.extension_col(F.col("path"))).where(G.glob_col(F.col("path"), pattern) & structural(ext=ext, paths=paths)).drop("ext")
        return candidates._with(rows, function="glob").limit(max_count)
    rows = live(entries).where(F.col("kind").isin("file", "directory"))
    if not prefix.startswith(P.META) and not any(p.startswith(P.META) for p in paths):
        rows = rows.where(~F.col("path").startswith(P.META + "/") & (F.col("path") != P.META))
    if whole:  # the pattern says no more than its prefix and extension
        files = (F.col("ext") == tail) & F.col("path").startswith(prefix)
        test = files | ((F.col("kind") == "directory") & G.glob_col(F.col("path"), pattern))
    else:
        test = G.glob_col(F.col("path"), pattern)
    rows = rows.where(test & structural(ext=ext, paths=paths))
    return Relation.by_path(rows.select("path", "kind", "size_bytes", "updated_at"), "glob").limit(max_count)
