"""Line-level text search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcgraph.functions import scalar as S


def search(content: DataFrame, query: str, path_part: str = "", limit: int = 50) -> DataFrame:
    """(path, line, content) of lines that hold ``query`` as it stands, in (path, line) order.

    Files without the query are dropped before they are cut into lines.
    """
    rows = content.where(F.contains("text", F.lit(query)))
    if path_part:
        rows = rows.where(F.contains("path", F.lit(path_part)))
    lines = rows.select("path", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).where(F.contains("raw", F.lit(query)))
    return lines.select("path", (F.col("pos") + 1).alias("line"), S.trimmed(F.col("raw")).alias("content")).orderBy("path", "line").limit(limit if limit > 0 else 50)
