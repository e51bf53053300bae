"""Unions that later joins and windows can rely on."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, by column name; columns that a frame lacks are null.

    Spark 4.1.2 may take a union as partitioned like its parts although their partitions differ in number, and
    a later join or window then loses rows; the session is told not to.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
