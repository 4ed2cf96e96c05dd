"""Changes to entries. Each takes the current rows and returns the next ones, which a sink writes; a write stages its batch.

A change is (entries, touched, errors): all rows after it, a relation of what it touched,
and a table of (path, error) for what it refused.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.functions import paths as P
from sylvan.functions import text as X
from sylvan.functions.shipping import ship
from sylvan.operators.relation import Relation
from sylvan.operators.scan import FEW_PATHS, at_paths, live, seeds
from sylvan.schema import ENTRY
from sylvan.sources.staging import cut
from sylvan.sources.tables import derive

NAMES = ENTRY.fieldNames()
#: Numbers of a history whose texts one task may take together.
RUN = 1000
_OF_VERSION = r"^/\.meta(/.+)/__meta__/versions/"


@dataclass(frozen=True)
class Change:
    entries: DataFrame
    touched: Relation
    errors: DataFrame
    #: Of a write, the rows that are new or changed.
    added: DataFrame | None = None


def _errors(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "path string, error string")


def _touched(rows: DataFrame, function: str) -> Relation:
    return Relation.by_path(rows.select("path", "kind", "size_bytes", "updated_at"), function)


def refused_col(path: Column, kind: Column) -> Column:
    """Why a write is refused, or null."""
    inner = path.startswith(P.META + "/")
    return (
        F.when(path.isin(P.ROOT, P.META), F.concat(F.lit("can't be changed: "), path))
        .when(F.length(path) > 1024, F.lit("path is longer than 1024 characters"))
        .when(path.rlike(r"[\x00-\x1f\x7f-\x9f]"), F.lit("path has a control character"))
        .when(path.rlike(r"[^/]{256,}"), F.lit("a segment is longer than 255 characters"))
        .when(path.contains(f"/{P.FRAME}/edges/in/"), F.lit("incoming edges are a view; write the outgoing edge"))
        .when(inner & ~path.contains(f"/{P.FRAME}"), F.concat(F.lit("no free content under /.meta: "), path))
        .when(~kind.isin("file", "chunk", "edge", "directory", "version", "api"), F.concat(F.lit("unknown kind: "), kind))
    )


def write(entries: DataFrame, rows: DataFrame, overwrite: bool = True, now: Column | None = None, versions: bool = True) -> Change:
    """Upsert of (path, content[, kind, …]): checked, with ancestors made or revived and versions of changed files.

    A file whose content no longer has its stored hash was changed from outside, and one
    whose last version doesn't have that hash has a broken history: the content that was
    found is kept first, as a snapshot ``external`` or ``repair``, and the write follows it.
    """
    now = now if now is not None else F.current_timestamp()
    staged = rows.withColumn("path", P.normalize_col(F.col("path")))
    staged = staged.withColumn("kind", F.coalesce("kind", P.kind_col(F.col("path"))) if "kind" in rows.columns else P.kind_col(F.col("path")))
    staged = staged.withColumn("_n", F.count("*").over(Window.partitionBy("path")))
    why = F.when(F.col("_n") > 1, F.lit("path occurs more than once in the batch")).otherwise(refused_col(F.col("path"), F.col("kind")))
    staged = staged.withColumn("_why", why)
    # what the batch meets is found among paths alone, and written so that its size is known: few paths are sent to where the texts lie
    hit = cut(entries.select("path").join(staged.select("path"), "path", "left_semi"), "hits")
    old = entries.join(hit, "path", "left_semi").select("path", F.col("content").alias("_old"), F.col("content_hash").alias("_hash"), F.col("kind").alias("_kind"), F.col("deleted_at").isNull().alias("_live"), F.col("version_number").alias("_version"), F.col("owner_id").alias("_belongs"))
    met = staged.join(old, "path", "left")
    if not overwrite:
        met = met.withColumn("_why", F.coalesce("_why", F.when(F.col("_live") & (F.col("_kind") == "file"), F.lit("already exists"))))
    # a chunk needs its file, live or in the batch; only chunks are joined with owners, as rows without one would all meet in one task
    owners = live(entries).where("kind = 'file'").select("path").unionByName(staged.where("_why is null and kind = 'file'").select("path")).select(F.col("path").alias("_owner"))
    chunks = staged.where("kind = 'chunk'").select("path", F.regexp_extract("path", r"^/\.meta(/.+?)/__meta__/", 1).alias("_owner"))
    lone = chunks.join(owners, "_owner", "left_anti").select("path", F.lit(True).alias("_lone")).distinct()
    met = met.join(lone, "path", "left").withColumn("_why", F.coalesce("_why", F.when(F.col("_lone"), F.lit("the chunk's file is missing"))))
    last = live(entries).where("kind = 'version'").select(F.regexp_extract("path", _OF_VERSION, 1).alias("_file"), F.col("version_number").alias("_at"), F.coalesce("content_hash", F.when(F.col("is_snapshot"), F.sha2("content", 256))).alias("_kept"))
    met = met.join(last, (F.col("path") == F.col("_file")) & (F.col("_version") == F.col("_at")), "left")
    # the batch with what was found of it is looked up once; all that follows reads it
    met = cut(met, "batch")
    good = met.where("_why is null")
    was_file = (F.col("kind") == "file") & F.coalesce("_live", F.lit(False)) & (F.coalesce("_version", F.lit(0)) > 0)
    found = F.sha2(F.coalesce("_old", F.lit("")), 256)
    mended = F.when(was_file & (F.col("_hash") != found), F.lit("external")).when(was_file & (F.coalesce("_kept", F.lit("")) != found), F.lit("repair"))
    good = good.withColumn("_mended", mended).withColumn("_base", F.coalesce("_version", F.lit(0)) + F.when(F.col("_mended").isNotNull(), 1).otherwise(0))
    same = was_file & (found == F.sha2("content", 256))
    number = F.col("_base") + F.when(same, 0).otherwise(1)
    fresh = good.where(~same)
    extra = [c for c in rows.columns if c in NAMES and c not in ("path", "kind", "content", "version_number", "updated_at", "created_at", "owner_id")]
    owner_id = F.coalesce("owner_id", "_belongs") if "owner_id" in rows.columns else F.col("_belongs")
    new = derive(good.select("path", "kind", "content", *extra, owner_id.alias("owner_id"), F.when(F.col("kind") == "file", number).alias("version_number"), now.alias("updated_at")))
    dirs = good.select(F.explode(P.ancestors_col(F.col("path"))).alias("path")).distinct().join(live(entries).where("kind = 'directory'").select("path"), "path", "left_anti").join(new.select("path"), "path", "left_anti")
    made = derive(dirs.select("path", F.lit("directory").alias("kind"), now.alias("updated_at")))
    added = new.unionByName(made)
    if versions:
        files = fresh.where("kind = 'file'").select("path", "content", F.when(F.col("_live"), F.col("_old")).alias("_prev"), number.alias("n"), F.lit("auto").alias("by"))
        kept_first = good.where("_mended is not null").select("path", F.coalesce("_old", F.lit("")).alias("content"), F.lit(None).cast("string").alias("_prev"), F.col("_base").alias("n"), F.col("_mended").alias("by"))
        added = added.unionByName(version_rows(files.unionByName(kept_first), now))
    kept = entries.join(added.select("path"), "path", "left_anti")
    errors = met.where("_why is not null").select("path", F.col("_why").alias("error")).distinct()
    return Change(kept.select(*NAMES).unionByName(added.select(*NAMES)), _touched(new, "write"), errors, added.select(*NAMES))


def numbered(rows: DataFrame, own: Iterable[str], by: str, text: str) -> DataFrame:
    """The rows with their number ``n`` among those of the same ``own`` in the order of ``by``, and the text before theirs as ``_prev``.

    Numbers are taken from keys alone and texts meet in runs of RUN numbers, so that no task
    reads all texts of one file.
    """
    own = list(own)
    key = [*own, by]
    before = Window.partitionBy(*own).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key).agg(F.count("*").alias("_m")).select(*(F.col(c).alias(f"_{c}") for c in key), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    each = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy(by)))
    same = F.lit(True)
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    each = each.join(starts, same).withColumn("n", (F.col("_start") + F.col("_at")).cast("int"))
    run = F.floor(F.col("n") / RUN)
    # the last of a run is also the one before the next run's first
    each = each.withColumn("_run", F.explode(F.when(F.col("n") % RUN == RUN - 1, F.array(run, run + 1)).otherwise(F.array(run))))
    return each.withColumn("_prev", F.lag(text).over(Window.partitionBy(*own, "_run").orderBy("n"))).where(F.col("_run") == run).select(*rows.columns, "n", "_prev")


def version_rows(files: DataFrame, now: Column) -> DataFrame:
    """Version entries of (path, content, _prev, n[, by]): a snapshot for the first, every tenth, and without a predecessor; else a diff. Each has the hash of its text."""
    ship()
    whole = X.is_snapshot_col(F.col("n")) | F.col("_prev").isNull()

    @F.pandas_udf("string")
    def changes(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else X.diff(x, y) for x, y in zip(a, b)])

    stored = files.withColumn("whole", whole)
    rows = stored.select(
        F.concat(F.lit(P.META), "path", F.lit(f"/{P.FRAME}/versions/"), F.col("n").cast("string")).alias("path"), F.lit("version").alias("kind"), F.when(F.col("whole"), F.col("content")).alias("content"),
        changes(F.when(~F.col("whole"), F.col("_prev")), F.when(~F.col("whole"), F.col("content"))).alias("version_diff"), F.col("n").cast("int").alias("version_number"), F.col("whole").alias("is_snapshot"), (F.col("by") if "by" in files.columns else F.lit("auto")).alias("created_by"), now.alias("updated_at"), F.sha2("content", 256).alias("_hash"),
    )
    return derive(rows, "_hash").withColumn("content_hash", F.col("_hash")).select(*NAMES)


def reconstruct(entries: DataFrame) -> DataFrame:
    """(path, version_number, content) of every stored version, replayed from the snapshot before it.

    Chains are cut at snapshots, so a group has at most ten rows however long the history.
    Snapshots are looked for among numbers alone: with its texts, a file's history would be one task's.
    """
    own = entries.where("kind = 'version'").select(F.regexp_extract("path", _OF_VERSION, 1).alias("path"), "version_number", "is_snapshot", F.coalesce("content", "version_diff").alias("stored"))
    ship()
    own = cut(own, "versions")
    w = Window.partitionBy("path").orderBy("version_number")
    bases = own.select("path", "version_number", F.max(F.when(F.col("is_snapshot"), F.col("version_number"))).over(w).alias("base")).distinct()
    chains = own.join(bases, ["path", "version_number"], "left")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("version_number")
        text, out = "", []
        for whole, stored in zip(pdf["is_snapshot"], pdf["stored"]):
            text = stored if whole else X.patch(text, stored)
            out.append(text)
        return pd.DataFrame({"path": pdf["path"], "version_number": pdf["version_number"], "content": out})

    return chains.groupBy("path", "base").applyInPandas(fold, "path string, version_number int, content string")


def below(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows at or below (path) roots, in their own tree or beside it under /.meta: equal joins on ancestors, no nested loop."""
    plain = F.when(F.col("path").startswith(P.META + "/"), F.regexp_replace(F.substr("path", F.lit(len(P.META) + 1)), f"/{P.FRAME}(/.*)?$", "")).otherwise(F.col("path"))
    ups = F.concat(P.ancestors_col(plain), F.array(plain))
    hit = rows.select("path", F.explode(ups).alias("root")).join(roots.select(F.col("path").alias("root")), "root", "left_semi").select("path").distinct()
    return rows.join(hit, "path", "left_semi")


def within(path: Column, root: str) -> Column:
    """Whether a path lies at or below a root or in the metadata of what does: tests of prefixes, which the scan takes."""
    inner = root[len(P.META) :].split(f"/{P.FRAME}", 1)[0] if root.startswith(P.META + "/") else None
    own = (path == root) | path.startswith(root + "/")
    return own if inner is not None and not inner else own | path.startswith(f"{P.META}{root}/")


def delete(entries: DataFrame, wanted: Iterable[str] | DataFrame | Relation, permanent: bool = False, cascade: bool = True, now: Column | None = None) -> Change:
    """Marks rows and all below them as deleted, or removes them."""
    now = now if now is not None else F.current_timestamp()
    alive = live(entries)
    if not isinstance(wanted, (Relation, DataFrame)):
        wanted = list(wanted)
    roots = at_paths(alive, wanted).select("path").where(~F.col("path").isin(P.ROOT, P.META))
    errors = seeds(entries, wanted).join(roots, "path", "left_anti").select("path", F.concat(F.lit("Not found: "), "path").alias("error"))
    if not cascade:
        parents = alive.select(F.col("parent_path").alias("path")).distinct()
        full = roots.join(parents, "path", "left_semi")
        errors = errors.unionByName(full.select("path", F.concat(F.lit("Not empty: "), "path").alias("error")))
        roots = roots.join(full, "path", "left_anti")
    rows = alive.select("path", "kind", "size_bytes", "updated_at")
    if isinstance(wanted, list) and len(wanted) <= FEW_PATHS:
        test = F.lit(False)
        for r in roots.toLocalIterator():  # at most FEW_PATHS
            test |= within(F.col("path"), r[0])
        gone = rows.where(test)
    else:
        gone = below(rows, roots)
    if permanent:
        kept = entries.join(gone.select("path"), "path", "left_anti")
    else:
        mark = gone.select("path", F.lit(True).alias("_gone"))
        kept = entries.join(mark, "path", "left").withColumn("deleted_at", F.when(F.col("_gone"), now).otherwise(F.col("deleted_at"))).select(*NAMES)
    return Change(kept, _touched(gone, "delete"), errors)


def mkdir(entries: DataFrame, paths: Iterable[str], now: Column | None = None) -> Change:
    rows = entries.sparkSession.createDataFrame([(P.normalize(p), "directory") for p in paths], "path string, kind string").withColumn("content", F.lit(None).cast("string"))
    return write(entries, rows, overwrite=False, now=now)


def mkedge(entries: DataFrame, links: DataFrame, now: Column | None = None) -> Change:
    """(source, target, type) as edge rows; the source must exist, the target need not."""
    known = links.join(live(entries).select(F.col("path").alias("source")), "source", "left_semi")
    lost = links.join(known, ["source", "target", "type"], "left_anti").select(F.col("source").alias("path"), F.concat(F.lit("Not found: "), "source").alias("error"))
    rows = known.select(P.edge_out_col(F.col("source"), F.col("target"), F.col("type")).alias("path"), F.lit("edge").alias("kind"), F.lit(None).cast("string").alias("content"), F.col("source").alias("source_path"), F.col("target").alias("target_path"), F.col("type").alias("edge_type")).distinct()
    done = write(entries, rows, now=now, versions=False)
    return Change(done.entries, Relation.by_path(done.touched.df, "mkedge"), done.errors.unionByName(lost))


def copy(entries: DataFrame, pairs: DataFrame, overwrite: bool = True, now: Column | None = None, owner: str | None = None) -> Change:
    """(src, dest): content alone is copied; the copy belongs to ``owner``."""
    pairs = cut(pairs, "pairs")
    found = pairs.join(live(entries).select(F.col("path").alias("src"), "content"), "src")
    lost = pairs.join(live(entries).select(F.col("path").alias("src")), "src", "left_anti").select(F.col("src").alias("path"), F.concat(F.lit("Not found: "), "src").alias("error"))
    done = write(entries, found.select(F.col("dest").alias("path"), "content", F.lit(owner).cast("string").alias("owner_id")), overwrite, now)
    return Change(done.entries, Relation.by_path(done.touched.df, "copy"), done.errors.unionByName(lost))


def moved_col(path: Column, src: str, dest: str) -> Column:
    return F.when(path == src, F.lit(dest)).when(path.startswith(src + "/"), F.concat(F.lit(dest), F.substr(path, F.lit(len(src) + 1)))).otherwise(path)


def move(entries: DataFrame, src: str, dest: str, now: Column | None = None) -> Change:
    """Renames a row with all below it and its metadata, and repoints edges at both ends. The destination must be free."""
    now = now if now is not None else F.current_timestamp()
    src, dest = P.normalize(src), P.normalize(dest)
    alive = live(entries)
    problem = None
    if alive.where(F.col("path") == src).isEmpty():
        problem = f"Not found: {src}"
    elif dest == src or dest.startswith(src + "/"):
        problem = f"can't move {src} into itself"
    elif not alive.where(F.col("path") == dest).isEmpty():
        problem = f"Already exists: {dest}"
    if problem:
        return Change(entries, _touched(alive.where("false"), "move"), entries.sparkSession.createDataFrame([(src, problem)], "path string, error string"))
    own = F.col("path")
    edge = F.col("kind") == "edge"
    source, target = moved_col(F.col("source_path"), src, dest), moved_col(F.col("target_path"), src, dest)
    meta = own.startswith(P.META + "/")
    to = F.when(edge, P.edge_out_col(source, target, F.col("edge_type"))).when(meta, F.concat(F.lit(P.META), moved_col(F.substr(own, F.lit(len(P.META) + 1)), src, dest))).otherwise(moved_col(own, src, dest))
    rows = alive.withColumn("_to", to)
    shifted = rows.where("_to <> path").withColumn("original_path", own).withColumn("source_path", F.when(edge, source)).withColumn("target_path", F.when(edge, target)).withColumn("path", F.col("_to")).withColumn("name", P.name_col(F.col("path"))).withColumn("parent_path", P.parent_col(F.col("path"))).withColumn("ext", F.when(F.col("kind") == "file", P.extension_col(F.col("path")))).withColumn("updated_at", now).select(*NAMES)
    rest = entries.join(rows.where("_to <> path").select("path"), "path", "left_anti").join(shifted.select("path"), "path", "left_anti")
    dirs = entries.sparkSession.createDataFrame([(p, "directory") for p in P.ancestors(dest)], "path string, kind string")
    made = derive(dirs.join(alive.select("path"), "path", "left_anti").withColumn("updated_at", now))
    return Change(rest.select(*NAMES).unionByName(shifted).unionByName(made), _touched(shifted, "move"), _errors(entries))


def moves(entries: DataFrame, pairs: DataFrame, now: Column | None = None) -> Change:
    """Many moves (src, dest) at once, as if made in the order of their sources: what lies below a moved row goes along with it.

    A row finds its move by equal joins on its ancestors. Refused are sources that aren't
    there or go along with another, destinations that are taken or wanted twice, and moves
    into themselves.
    """
    now = now if now is not None else F.current_timestamp()
    alive = live(entries)
    asked = pairs.select(P.normalize_col(F.col("src")).alias("src"), P.normalize_col(F.col("dest")).alias("dest")).groupBy("src").agg(F.min("dest").alias("dest"))
    there = alive.select(F.col("path").alias("src"), F.lit(True).alias("_there"))
    taken = alive.select(F.col("path").alias("dest"), F.lit(True).alias("_taken"))
    along = asked.select("src", F.explode(P.ancestors_col(F.col("src"))).alias("up")).join(asked.select(F.col("src").alias("up")), "up", "left_semi").select("src", F.lit(True).alias("_along")).distinct()
    first = Window.partitionBy("dest")
    why = (
        F.when(F.col("_there").isNull() | F.col("_along").isNotNull(), F.concat(F.lit("Not found: "), "src"))
        .when((F.col("dest") == F.col("src")) | F.col("dest").startswith(F.concat("src", F.lit("/"))), F.concat(F.lit("can't move "), "src", F.lit(" into itself")))
        .when(F.col("_taken").isNotNull() | (F.col("src") != F.min("src").over(first)), F.concat(F.lit("Already exists: "), "dest"))
    )
    rated = cut(asked.join(there, "src", "left").join(along, "src", "left").join(taken, "dest", "left").withColumn("_why", why), "moves")
    good = rated.where("_why is null").select("src", "dest")

    own, edge = F.col("path"), F.col("kind") == "edge"
    meta = own.startswith(P.META + "/")
    rows = alive.withColumn("_own", F.when(~edge, F.when(meta, F.regexp_replace(F.substr("path", F.lit(len(P.META) + 1)), f"/{P.FRAME}(/.*)?$", "")).otherwise(own)))
    plain = rows.select(F.explode(F.array_compact(F.array("_own", "source_path", "target_path"))).alias("_p")).distinct()
    hit = plain.select("_p", F.explode(F.concat(P.ancestors_col(F.col("_p")), F.array("_p"))).alias("src")).join(good, "src")
    new = cut(hit.select("_p", F.concat("dest", F.substr("_p", F.length("src") + 1)).alias("_to")), "moves")
    for column, to in (("_own", "_to_own"), ("source_path", "_to_source"), ("target_path", "_to_target")):
        rows = rows.join(new.select(F.col("_p").alias(column), F.col("_to").alias(to)), column, "left")
    source, target = F.coalesce("_to_source", "source_path"), F.coalesce("_to_target", "target_path")
    tail = F.substr("path", F.length("_own") + len(P.META) + 1)
    to = F.when(edge & (F.col("_to_source").isNotNull() | F.col("_to_target").isNotNull()), P.edge_out_col(source, target, F.col("edge_type"))).when(~edge & meta, F.concat(F.lit(P.META), "_to_own", tail)).when(~edge, F.col("_to_own"))
    changed = cut(rows.withColumn("_to", to).where("_to is not null"), "moves")
    shifted = changed.withColumns({"original_path": own, "source_path": F.when(edge, source), "target_path": F.when(edge, target), "path": F.col("_to"), "updated_at": now})
    shifted = shifted.withColumns({"name": P.name_col(F.col("path")), "parent_path": P.parent_col(F.col("path")), "ext": F.when(F.col("kind") == "file", P.extension_col(F.col("path")))}).select(*NAMES)
    rest = entries.join(changed.select("path"), "path", "left_anti").join(shifted.select("path"), "path", "left_anti")
    dirs = good.select(F.explode(P.ancestors_col(F.col("dest"))).alias("path")).distinct().withColumn("kind", F.lit("directory"))
    made = derive(dirs.join(rest.where("deleted_at is null").select("path"), "path", "left_anti").join(shifted.select("path"), "path", "left_anti").withColumn("updated_at", now))
    errors = rated.where("_why is not null").select(F.col("src").alias("path"), F.col("_why").alias("error"))
    return Change(rest.join(made.select("path"), "path", "left_anti").select(*NAMES).unionByName(shifted).unionByName(made), _touched(shifted, "move"), errors)


def edit(entries: DataFrame, wanted: Iterable[str] | DataFrame | Relation, edits: Iterable[tuple[str, str, bool]], now: Column | None = None) -> Change:
    """Edits in turn on every file; a file that one of them doesn't fit stays as it was and is reported."""
    rows = live(entries).where("kind = 'file'").join(seeds(entries, wanted), "path", "left_semi").select("path", "content")
    edits = list(edits)
    ship()

    @F.pandas_udf("content string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            error = None
            for old, new, every in edits:
                done = X.edit(t or "", old, new, every)
                if not done.success:
                    error = done.error
                    break
                t = done.content
            out.append((None if error else t, error))
        return pd.DataFrame(out, columns=["content", "error"])

    tried = cut(rows.select("path", run("content").alias("x")), "edits")
    done = write(entries, tried.where("x.error is null").select("path", F.col("x.content").alias("content")), now=now)
    lost = seeds(entries, wanted).join(rows.select("path"), "path", "left_anti").select("path", F.concat(F.lit("Not found: "), "path").alias("error"))
    errors = done.errors.unionByName(tried.where("x.error is not null").select("path", F.col("x.error").alias("error"))).unionByName(lost)
    return Change(done.entries, Relation.by_path(done.touched.df, "edit"), errors)


def resolve_rules(rows: DataFrame, rules: DataFrame, default: str = "read_write") -> DataFrame:
    """(path, permission): the rule (prefix, permission) with the longest prefix; found by equal joins on ancestors."""
    plain = F.when(F.col("path").startswith(P.META + "/"), F.regexp_replace(F.substr("path", F.lit(len(P.META) + 1)), f"/{P.FRAME}(/.*)?$", "")).otherwise(F.col("path"))
    ups = F.concat(F.array(F.lit("/")), P.ancestors_col(plain), F.array(plain))
    hit = rows.select("path", F.explode(ups).alias("prefix")).join(rules, "prefix").groupBy("path").agg(F.max_by("permission", F.length("prefix")).alias("permission"))
    return rows.select("path").join(hit, "path", "left").select("path", F.coalesce("permission", F.lit(default)).alias("permission"))


def transfer(source: DataFrame, target: DataFrame, pairs: DataFrame, remove: bool = False, overwrite: bool = True, now: Column | None = None, owner: str | None = None) -> tuple[Change, Change | None]:
    """Copies (src, dest) from one mount's entries to another's; for a move the sources that were written are deleted then."""
    found = live(source).join(pairs.select(F.col("src").alias("path"), "dest"), "path").select("path", "dest", "content")
    lost = pairs.join(live(source).select(F.col("path").alias("src")), "src", "left_anti").select(F.col("src").alias("path"), F.concat(F.lit("Not found: "), "src").alias("error"))
    done = write(target, found.select(F.col("dest").alias("path"), "content", F.lit(owner).cast("string").alias("owner_id")), overwrite, now)
    into = Change(done.entries, done.touched, done.errors.unionByName(lost))
    if not remove:
        return into, None
    kept = done.errors.select(P.normalize_col(F.col("path")).alias("dest"))
    written = found.select("path", P.normalize_col(F.col("dest")).alias("dest")).join(kept, "dest", "left_anti").select("path")
    return into, delete(source, written, now=now)
