"""Files and rows that keep arriving: each micro-batch is upserted into a table of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sylvan.operators.store import write
from sylvan.sources.tables import derive


class EntryTable:
    """Entries as a base and the changes of each batch since, in numbered folders.

    A batch writes the rows that it changes alone (``d<n>``); after COMPACT batches the next
    one writes a base (``b<n>``), and what was before the last base goes. A batch that is
    replayed finds its folder and does nothing.
    """

    COMPACT = 16

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _written(self) -> list[tuple[int, str]]:
        """(batch, kind) of all folders that were written to their end."""
        fs, at = self._fs()
        if not fs.exists(at):
            return []
        names = [s.getPath() for s in fs.listStatus(at)]
        done = [p.getName() for p in names if p.getName()[:1] in "bd" and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted((int(n[1:]), n[0]) for n in done)

    def _load(self, n: int, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{kind}{n}")

    def read(self) -> DataFrame:
        found = self._written()
        base = max((n for n, kind in found if kind == "b"), default=None)
        rows = self._load(base, "b") if base is not None else derive(self.spark.createDataFrame([], "path string, content string"))
        for n in (n for n, kind in found if kind == "d" and (base is None or n > base)):
            new = self._load(n, "d")
            rows = rows.join(new.select("path"), "path", "left_anti").select(*new.columns).unionByName(new)
        return rows

    def upsert(self, rows: DataFrame, version: int) -> None:
        found = self._written()
        if any(n == version for n, _ in found):
            return
        last = rows.groupBy("path").agg(F.max_by("content", "ts").alias("content"), F.max("ts").alias("ts"))
        change = write(self.read(), last.select("path", "content"), now=F.current_timestamp())
        base = max((n for n, kind in found if kind == "b"), default=-1)
        full = base < 0 or sum(1 for n, kind in found if kind == "d" and n > base) >= self.COMPACT
        out = change.entries if full else change.added
        out.write.mode("overwrite").parquet(f"{self.folder}/{'b' if full else 'd'}{version}")
        if full:
            self._drop([(n, kind) for n, kind in found if n < base])

    def _drop(self, old: list[tuple[int, str]]) -> None:
        """What lies before the base before: readers of the last one may still be at work."""
        fs, _ = self._fs()
        for n, kind in old:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}{n}"), True)


def ingest(stream: DataFrame, table: EntryTable) -> DataStreamWriter:
    """A stream of (path, content, ts) into the table; of one path in a batch the latest row wins."""
    return stream.writeStream.foreachBatch(lambda batch, n: table.upsert(batch, n))


def activity(stream: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a window and type, as they come: (ts, event_type, …) with late rows up to the watermark."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
