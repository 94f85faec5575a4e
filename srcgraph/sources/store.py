"""The index on disk: Parquet generations and a pointer to the present one.

A run writes a whole new generation and then moves the pointer, so readers see
the old index or the new one, never a mixture; a failed run leaves no trace but
an unreferenced folder. A generation's number is claimed by creating a file that
must not exist, so two writers never share a folder. The generation before the
present one stays for readers that have just begun; older ones are removed.
"""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcgraph.operators import fts, rank
from srcgraph.runtime import release, settle
from srcgraph.schema import CONTENT, FILES, IMPORTS, SYMBOLS, Tables
from srcgraph.sources import tree
from srcgraph.sources.registry import DEFAULT, Registry

#: Runs of one process on one index go one after the other.
_locks: dict[str, threading.Lock] = defaultdict(threading.Lock)
TABLES = {"files": FILES, "symbols": SYMBOLS, "imports": IMPORTS, "content": CONTENT}


@dataclass
class Stats:
    files: int
    symbols: int
    imports: int
    indexed: int
    skipped: int
    failed: int
    duration_sec: float


def classify(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, state) of the files of two (path, content_hash) snapshots: new, changed, unchanged or deleted."""
    o, n = old.select("path", F.col("content_hash").alias("old")), new.select("path", F.col("content_hash").alias("new"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return o.join(n, "path", "full_outer").select("path", state.alias("state"))


def upsert(old: DataFrame, fresh: DataFrame, by: str = "path", replaced: DataFrame | None = None) -> DataFrame:
    """``old`` with the rows of ``fresh`` in place of those of the same ``by``, or of all that ``replaced`` names."""
    return without(old, fresh if replaced is None else replaced, by).unionByName(fresh)


def without(table: DataFrame, gone: DataFrame, by: str = "path") -> DataFrame:
    return table.join(gone.select(by).distinct(), by, "left_anti")


class Store:
    """An index under ``location``, any path that Spark's file systems reach."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.location).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def generation(self) -> int:
        pointer = self._path(f"{self.location}/CURRENT")
        if not self._fs.exists(pointer):
            return 0
        stream = self._fs.open(pointer)
        try:
            return int(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def tables(self) -> Tables:
        """The present index; empty tables before the first run."""
        g = self.generation()
        read = (lambda n: self.spark.read.schema(TABLES[n]).parquet(f"{self.location}/gen-{g}/{n}")) if g else (lambda n: self.spark.createDataFrame([], TABLES[n]))
        return Tables(*(read(n) for n in TABLES))

    def postings(self) -> DataFrame:
        g = self.generation()
        return self.spark.read.parquet(f"{self.location}/gen-{g}/postings") if g else fts.postings(self.tables().symbols)

    def weights(self) -> rank.Weights | None:
        """Tokens and norms of the present index; none before the first run."""
        g = self.generation()
        return rank.Weights(*(self.spark.read.parquet(f"{self.location}/gen-{g}/{n}") for n in ("tokens", "norms", "total"))) if g else None

    def _claim(self) -> int:
        """The number of a generation that no other writer has."""
        g = self.generation() + 1
        while True:
            try:
                self._fs.create(self._path(f"{self.location}/gen-{g}.claim"), False).close()
                return g
            except Exception:
                if not self._fs.exists(self._path(f"{self.location}/gen-{g}.claim")):
                    raise
                g += 1

    def _forget(self, present: int) -> None:
        for status in self._fs.listStatus(self._path(self.location)):
            name = status.getPath().getName()
            number = name.removeprefix("gen-").removesuffix(".claim")
            if name.startswith("gen-") and number.isdigit() and int(number) < present - 1:
                self._fs.delete(status.getPath(), True)

    def write(self, t: Tables) -> int:
        """A new generation: tables clustered by path, postings and tokens by token, so that lookups skip row groups."""
        g = self._claim()
        base = f"{self.location}/gen-{g}"
        for name in TABLES:
            df = getattr(t, name).select(*TABLES[name].fieldNames())
            df.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").parquet(f"{base}/{name}")
        written = self.spark.read.schema(SYMBOLS).parquet(f"{base}/symbols")
        fts.postings(written).repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{base}/postings")
        kept = rank.weights(written)
        kept.tokens.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{base}/tokens")
        kept.norms.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").parquet(f"{base}/norms")
        kept.total.write.mode("overwrite").parquet(f"{base}/total")
        temp, pointer = self._path(f"{self.location}/CURRENT.next-{g}"), self._path(f"{self.location}/CURRENT")
        out = self._fs.create(temp, True)
        out.write(bytearray(str(g).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        option = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(option, 1)
        array[0] = option.OVERWRITE
        context.rename(temp, pointer, array)
        self._forget(g)
        return g

    def index(self, root: str, incremental: bool = True, registry: Registry = DEFAULT) -> Stats:
        """Bring the index up to date with the files under ``root``.

        Only new and changed files are extracted; a full run (``incremental``
        false) forgets the old hashes and extracts all. Files that can't be read
        keep what the index has of them; vanished ones go from all tables.
        """
        with _locks[self.location]:
            return self._index(root, incremental, registry)

    def _index(self, root: str, incremental: bool, registry: Registry) -> Stats:
        began = time.time()
        old = self.tables()
        listed = settle(tree.paths(self.spark, root, registry))
        known = old.files.select("path", F.col("content_hash").alias("old_hash"))
        asked = listed.join(known, "path", "left") if incremental else listed.withColumn("old_hash", F.lit(None).cast("string"))
        seen = settle(tree.scan(asked.repartition(max(1, listed.rdd.getNumPartitions())), root, registry))
        fresh = seen.where(F.col("state").isin("new", "changed"))
        # a file that can't be read is still there
        now = seen.select("path", F.coalesce("content_hash", F.lit("")).alias("content_hash"))
        gone = settle(classify(old.files, now).where("state = 'deleted'").select("path"))
        parts = {
            "files": fresh.select("path", "language", "content_hash", "size", F.current_timestamp().alias("indexed_at")),
            "symbols": fresh.select("path", F.inline("symbols")),
            "imports": fresh.select("path", F.inline("imports")),
            "content": fresh.select("path", "text"),
        }
        self.write(Tables(*(upsert(without(getattr(old, n), gone), parts[n], replaced=fresh) for n in TABLES)))
        state = {r["state"]: r["count"] for r in seen.groupBy("state").count().collect()}
        total = {n: getattr(self.tables(), n).count() for n in ("files", "symbols", "imports")}
        indexed = state.get("new", 0) + state.get("changed", 0)
        skipped = state.get("unchanged", 0) + gone.count()
        release(listed, seen, gone)
        return Stats(**total, indexed=indexed, skipped=skipped, failed=state.get("failed", 0) + (state.get("unreadable", 0) if not incremental else 0), duration_sec=round(time.time() - began, 3))

    def delete(self, path: str) -> None:
        """Take a file out of all tables."""
        with _locks[self.location]:
            old = self.tables()
            gone = self.spark.createDataFrame([(path,)], "path string")
            self.write(Tables(*(without(getattr(old, n), gone) for n in TABLES)))
