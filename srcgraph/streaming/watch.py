"""Continuous indexing, an extension: a stream of ticks drives incremental runs.

Each micro-batch lists the tree itself and looks at hashes, so it sees every name
(file streams hide those that begin with ``_`` or ``.``), rewritten files and
deletions alike. A tick at which nothing has changed writes no generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from srcgraph.sources import tree
from srcgraph.sources.store import Store, classify


def changed(store: Store, root: str) -> bool:
    """Whether any file under ``root`` is new, gone or not as the index has it."""
    known = store.tables().files
    listed = tree.paths(store.spark, root).join(known.select("path", known["content_hash"].alias("old_hash")), "path", "left")
    now = tree.scan(listed, root).selectExpr("path", "coalesce(content_hash, '') AS content_hash")
    return not classify(known, now).where("state <> 'unchanged'").isEmpty()


def watch(store: Store, root: str, checkpoint: str, interval: float = 10.0, once: bool = False) -> StreamingQuery:
    """A running query that keeps the index up to date every ``interval`` seconds, or brings it up to date ``once``."""
    ticks = store.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def run(batch: DataFrame, _: int) -> None:
        if changed(store, root):
            store.index(root, incremental=True)

    writer = ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(interval, 1):g} seconds")).start()
