"""Voxel statistics kept up to date while points arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def voxel_updates(points: DataFrame, size: float) -> DataFrame:
    """``cx, cy, cz, n, x, y, z``: the number and mean of the points in each cell so far. On a stream of ``id, x, y, z`` the state is
    one row for each occupied cell; on a table it is the same as a batch."""
    cells = points.select("x", "y", "z", *[F.floor(F.col(a) / size).cast("long").alias(f"c{a}") for a in "xyz"])
    return cells.groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"), *[F.avg(a).alias(a) for a in "xyz"])


def watch(updates: DataFrame, on_batch, checkpoint: str):
    """Start a stream that hands every batch of changed cells to ``on_batch(rows, number)``; progress is kept in ``checkpoint``."""
    return updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(on_batch).start()
