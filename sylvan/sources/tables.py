"""Entries and edges from the given tables, from folders of files, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.functions import paths as P
from sylvan.functions import text as X
from sylvan.schema import ENTRY

#: The same rows in SQL, for comparison.
FILES_SQL = """files AS (
 SELECT '/docs/' || lang || '/' || source || '/' || doc_id || '.' || (['md', 'txt', 'py', 'rst'])[doc_id % 4 + 1] AS path, text AS content FROM documents
 UNION ALL SELECT '/pages/' || page_id || '.html', html FROM pages
 UNION ALL SELECT '/conv/' || conv_id || '/' || turn || '.md', text FROM conversations)"""
EDGES_SQL = """edges AS (
 SELECT DISTINCT src, dst, type FROM (
 SELECT '/orders/' || o_orderkey AS src, '/customers/' || o_custkey AS dst, 'placed_by' AS type FROM orders
 UNION ALL SELECT '/customers/' || c_custkey, '/nations/' || c_nationkey, 'in' FROM customer
 UNION ALL SELECT '/suppliers/' || s_suppkey, '/nations/' || s_nationkey, 'in' FROM supplier
 UNION ALL SELECT '/nations/' || n_nationkey, '/regions/' || n_regionkey, 'in' FROM nation
 UNION ALL SELECT '/orders/' || l_orderkey, '/parts/' || l_partkey, 'contains' FROM lineitem
 UNION ALL SELECT '/parts/' || l_partkey, '/suppliers/' || l_suppkey, 'supplied_by' FROM lineitem))"""
RING_SQL = """ring AS (
 SELECT DISTINCT src, dst FROM (
 SELECT '/parts/' || l_partkey AS src, '/suppliers/' || l_suppkey AS dst FROM lineitem
 UNION ALL SELECT '/suppliers/' || s_suppkey, '/nations/' || s_nationkey FROM supplier
 UNION ALL SELECT '/nations/' || n_nationkey, '/regions/' || n_regionkey FROM nation
 UNION ALL SELECT '/regions/' || r_regionkey, '/parts/' || p_partkey FROM region, part WHERE p_size % 5 = r_regionkey))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of documents, pages and conversations as files."""
    part = lambda *cols: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cols])
    c = F.col
    ext = F.element_at(F.array(*map(F.lit, ("md", "txt", "py", "rst"))), (c("doc_id") % 4 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(part("/docs/", c("lang"), "/", c("source"), "/", c("doc_id"), ".", ext).alias("path"), c("text").alias("content"))
    pages = table(spark, sf_dir, "pages").select(part("/pages/", c("page_id"), ".html").alias("path"), c("html").alias("content"))
    talks = table(spark, sf_dir, "conversations").select(part("/conv/", c("conv_id"), "/", c("turn"), ".md").alias("path"), c("text").alias("content"))
    return docs.unionByName(pages).unionByName(talks)


def derive(df: DataFrame, *also: str) -> DataFrame:
    """Full entry rows: what isn't given follows from path and content. Columns in ``also`` stay beside them."""
    have = set(df.columns)
    get = lambda n: F.col(n) if n in have else F.lit(None).cast(ENTRY[n].dataType)
    path = F.col("path")
    kind: Column = F.coalesce(get("kind"), P.kind_col(path))
    content = F.when(kind == "directory", None).otherwise(F.when((kind == "file") & get("version_diff").isNull(), F.coalesce(get("content"), F.lit(""))).otherwise(get("content")))
    edge = P.split_edge_col(path)
    made = {
        "id": F.coalesce(get("id"), F.sha2(path, 256).substr(1, 36)), "name": P.name_col(path), "parent_path": P.parent_col(path), "kind": kind, "content": content, "content_hash": F.sha2(content, 256),
        "ext": F.when(kind == "file", P.extension_col(path)), "lines": X.line_count_col(content).cast("int"), "size_bytes": F.octet_length(content).cast("long"), "tokens": F.coalesce(get("tokens"), F.lit(0)), "lexical_tokens": F.coalesce(get("lexical_tokens"), F.size(X.tokens_col(content))),
        "source_path": F.coalesce(get("source_path"), edge["source"]), "target_path": F.coalesce(get("target_path"), edge["target"]), "edge_type": F.coalesce(get("edge_type"), edge["type"]),
        "created_at": F.coalesce(get("created_at"), F.lit("2020-01-01").cast("timestamp")), "updated_at": F.coalesce(get("updated_at"), F.lit("2020-01-01").cast("timestamp")),
    }
    return df.select(*[made.get(f.name, get(f.name)).cast(f.dataType).alias(f.name) for f in ENTRY], *also)


def with_directories(files: DataFrame) -> DataFrame:
    """The files with a directory row for every ancestor."""
    dirs = files.select(F.explode(P.ancestors_col(F.col("path"))).alias("path")).distinct().select("path", F.lit("directory").alias("kind"))
    return files.withColumn("kind", F.lit("file")).unionByName(dirs, allowMissingColumns=True)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(with_directories(text_files(spark, sf_dir)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, type) of the commercial tables."""
    c, t = F.col, lambda n: table(spark, sf_dir, n)
    link = lambda df, a, x, b, y, kind: df.select(F.concat(F.lit(a), c(x)).alias("src"), F.concat(F.lit(b), c(y)).alias("dst"), F.lit(kind).alias("type"))
    line = t("lineitem")
    out = link(t("orders"), "/orders/", "o_orderkey", "/customers/", "o_custkey", "placed_by")
    for part in (link(t("customer"), "/customers/", "c_custkey", "/nations/", "c_nationkey", "in"), link(t("supplier"), "/suppliers/", "s_suppkey", "/nations/", "s_nationkey", "in"), link(t("nation"), "/nations/", "n_nationkey", "/regions/", "n_regionkey", "in"), link(line, "/orders/", "l_orderkey", "/parts/", "l_partkey", "contains"), link(line, "/parts/", "l_partkey", "/suppliers/", "l_suppkey", "supplied_by")):
        out = out.unionByName(part)
    return out.distinct()


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of a graph with cycles: parts, suppliers, nations, regions and back."""
    c, t = F.col, lambda n: table(spark, sf_dir, n)
    at = lambda a, x: F.concat(F.lit(a), c(x))
    back = t("part").join(F.broadcast(t("region")), c("p_size") % 5 == c("r_regionkey")).select(at("/regions/", "r_regionkey").alias("src"), at("/parts/", "p_partkey").alias("dst"))  # region has five rows
    out = t("lineitem").select(at("/parts/", "l_partkey").alias("src"), at("/suppliers/", "l_suppkey").alias("dst"))
    out = out.unionByName(t("supplier").select(at("/suppliers/", "s_suppkey").alias("src"), at("/nations/", "s_nationkey").alias("dst")))
    return out.unionByName(t("nation").select(at("/nations/", "n_nationkey").alias("src"), at("/regions/", "n_regionkey").alias("dst"))).unionByName(back).distinct()


def edge_entries(edges: DataFrame) -> DataFrame:
    return derive(edges.select(P.edge_out_col(F.col("src"), F.col("dst"), F.col("type")).alias("path"), F.lit("edge").alias("kind")))


def read_folder(spark: SparkSession, folder: str, mount: str = "") -> DataFrame:
    """Text files of a folder, one row each, below ``mount``."""
    root = folder.removeprefix("file:").rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = F.regexp_replace(F.regexp_replace(F.col("path"), "^[a-z0-9]+:/+", "/"), f"^{root}", "")
    return derive(raw.select(F.concat(F.lit(mount.rstrip("/")), below).alias("path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("updated_at")))


def write_entries(df: DataFrame, folder: str) -> None:
    """Parquet partitioned by kind and in ranges of paths, so that file and row-group statistics prune prefixes."""
    df.repartitionByRange("kind", "path").sortWithinPartitions("kind", "path").write.mode("overwrite").partitionBy("kind").parquet(folder)


def read_entries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select(*ENTRY.fieldNames())


def line_chunks(files: DataFrame, size: int = 65536, overlap: int = 0) -> DataFrame:
    """(path, chunk_no, line_start, line_end, content): chunks of about ``size`` characters, cut at line ends.

    The running length picks each line's chunk within its file, so nothing shuffles; the
    last ``overlap`` lines of a chunk also begin the next one.
    """
    lines = F.split("content", "\n")
    running = F.aggregate(lines, F.struct(F.array().cast("array<long>").alias("at"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(F.concat(a["at"], F.array(a["n"])).alias("at"), (a["n"] + F.length(x) + 1).alias("n")), lambda a: a["at"])
    numbered = files.where("content is not null and content <> ''").select("path", F.posexplode(F.arrays_zip(lines.alias("line"), F.transform(running, lambda n: F.floor(n / size).cast("int")).alias("chunk"))).alias("pos", "x"))
    own = numbered.select("path", F.col("x.chunk").alias("chunk_no"), (F.col("pos") + 1).alias("line_no"), F.col("x.line").alias("line"))
    rows = own.groupBy("path", "chunk_no").agg(F.min("line_no").alias("line_start"), F.max("line_no").alias("line_end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("content"))
    if not overlap:
        return rows
    before = rows.select("path", (F.col("chunk_no") + 1).alias("chunk_no"), F.slice(F.split("content", "\n"), F.greatest(F.lit(1), F.size(F.split("content", "\n")) - overlap + 1), F.lit(overlap)).alias("tail"))
    return rows.join(before, ["path", "chunk_no"], "left").select("path", "chunk_no", (F.col("line_start") - F.coalesce(F.size("tail"), F.lit(0))).alias("line_start"), "line_end", F.concat_ws("\n", F.array_join("tail", "\n"), "content").alias("content"))


def token_windows(files: DataFrame, size: int = 512, overlap: int = 64, token: str = r"\w+|[^\w\s]") -> DataFrame:
    """(path, chunk_no, token_start, token_end, tokens): windows of ``size`` tokens, of which ``overlap`` are shared with the next one.

    The last window ends with the text; a text without tokens has none. A window is cut from
    its own file's tokens, so nothing shuffles.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    step = size - overlap
    own = files.where("content is not null").select("path", F.regexp_extract_all("content", F.lit(f"({token})"), F.lit(1)).alias("all")).where(F.size("all") > 0)
    count = F.greatest(F.lit(1), F.ceil((F.size("all") - overlap) / step)).cast("int")
    rows = own.select("path", "all", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    begin = F.col("chunk_no") * step
    return rows.select("path", "chunk_no", begin.cast("long").alias("token_start"), F.least(begin + size, F.size("all")).cast("long").alias("token_end"), F.slice("all", begin + 1, F.lit(size)).alias("tokens"))
