"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.sources.tables import new_path, saved, shared_dir, table

__all__ = ["BROADCAST_ROWS", "new_path", "saved", "shared_dir", "small", "table", "unit_hash"]

#: A side is only marked for broadcast when it has been counted and holds at
#: most this many short rows; beyond it the planner uses a shuffled join.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` was counted to hold few rows, else leave it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unit_hash(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    h = F.xxhash64(F.lit(seed), *cols)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))
