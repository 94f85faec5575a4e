"""Import-graph operators over edges (path, source, ord).

Traversals advance a frontier by joins. Each level is written to the shared
folder, so plans stay short and an executor may be lost; loops end with the
first empty level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from srcgraph.runtime import settle


def edges_of(imports: DataFrame) -> DataFrame:
    return imports.select("path", "source").distinct()


def direct_imports(imports: DataFrame, path: str) -> DataFrame:
    return imports.where(F.col("path") == path).select("source").distinct().orderBy("source")


def direct_importers(imports: DataFrame, source: str) -> DataFrame:
    return imports.where(F.col("source") == source).select("path").distinct().orderBy("path")


def _starts(imports: DataFrame, nodes: list[str] | DataFrame) -> DataFrame:
    if isinstance(nodes, DataFrame):
        return nodes.select("node").distinct()
    return imports.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(nodes)], "node string")


def _levels(starts: DataFrame, step, depth: int) -> DataFrame:
    """(start, node, depth) of what ``step`` reaches from each start, the start itself left out."""
    front = settle(starts.select(F.col("node").alias("start"), "node"))
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = settle(step(front).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    return seen.where("depth > 0")


def dependencies(imports: DataFrame, nodes: list[str] | DataFrame, depth: int = 10) -> DataFrame:
    """(start, node, depth): forward reach within ``depth`` steps."""
    edges = settle(edges_of(imports))

    def step(front: DataFrame) -> DataFrame:
        return front.join(edges, front["node"] == edges["path"]).select("start", F.col("source").alias("node"))

    return _levels(_starts(imports, nodes), step, depth if depth > 0 else 10)


def dependents(imports: DataFrame, nodes: list[str] | DataFrame, depth: int = 10) -> DataFrame:
    """(start, node, depth): a node with imports leads to all that share one of them, any other to its importers."""
    edges = settle(edges_of(imports))
    expanded: list[DataFrame] = []

    def step(front: DataFrame) -> DataFrame:
        via = front.join(edges, front["node"] == edges["path"], "left").select("start", F.coalesce("source", "node").alias("via")).distinct()
        # what a start has been through leads to nothing new, however many import it
        for done in expanded:
            via = via.join(done, ["start", "via"], "left_anti")
        via = settle(via)
        expanded.append(via)
        return via.join(edges, via["via"] == edges["source"]).select("start", F.col("path").alias("node"))

    return _levels(_starts(imports, nodes), step, depth if depth > 0 else 10)


def related(imports: DataFrame, path: str, top: int = 10) -> DataFrame:
    """(path, shared): files that import most of what ``path`` imports, import rows counted one by one."""
    mine = imports.where(F.col("path") == path).select("source").distinct()
    found = imports.where(F.col("path") != path).join(mine, "source", "left_semi")
    return found.groupBy("path").agg(F.count("*").alias("shared")).orderBy(F.desc("shared"), "path").limit(top if top > 0 else 10)


def trace(imports: DataFrame, start: str, goal: str, max_nodes: int = 5) -> DataFrame:
    """(pos, path) of a shortest chain of files from ``start`` to ``goal`` in which neighbours share an import.

    At most ``max_nodes`` files; empty if there is none. Of several, each file's
    parent is the least. The goal counts as reached where it imports, too.
    """
    spark = imports.sparkSession
    if start == goal:
        return spark.createDataFrame([(0, start)], "pos int, path string")
    edges = settle(edges_of(imports))
    front = settle(spark.createDataFrame([(start, None)], "node string, parent string"))
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, max_nodes):
        via = front.join(edges, front["node"] == edges["path"]).groupBy("source").agg(F.min("node").alias("parent"))
        reached = via.join(edges, "source").groupBy(F.col("path").alias("node")).agg(F.min("parent").alias("parent"))
        front = settle(reached.join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
        if not front.where(F.col("node") == goal).isEmpty():
            break
    seen = settle(seen)
    chain, at = [], goal
    while True:  # a chain has at most ``max_nodes`` files
        row = seen.where(F.col("node") == at).select("parent").first()
        if row is None:
            chain = []
            break
        chain.append(at)
        if row.parent is None:
            break
        at = row.parent
    return spark.createDataFrame([(i, p) for i, p in enumerate(reversed(chain))], "pos int, path string")


def merged_windows(df: DataFrame, by: list[str]) -> DataFrame:
    """Merge overlapping or adjacent [first, last] ranges of each group: (by, first, last)."""
    w = W.partitionBy(*by).orderBy("first", "last")
    far = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
    flagged = df.withColumn("_new", F.when(far.isNull() | (F.col("first") > far + 1), 1).otherwise(0))
    islands = flagged.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_island")
