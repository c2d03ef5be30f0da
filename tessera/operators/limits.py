"""Scan limits on a table of events: everything before the first event that goes beyond a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.model import ScanLimits

#: Ranges of positions that running totals are made in, side by side.
RANGES = 256


def _ranged(events: DataFrame, pos_col: str) -> Column:
    """Number of the range that a position is in; the bounds are quantiles, at most RANGES of them."""
    bounds = sorted(set(events.approxQuantile(pos_col, [i / RANGES for i in range(1, RANGES)], 0.001)))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col(pos_col)))


def within_limits(events: DataFrame, limits: ScanLimits, pos_col: str = "pos", kind_col: str = "kind", size_col: str = "size") -> DataFrame:
    """events, of kind `file` or `directory` in the order of numeric positions, up to the first that trips.

    Totals are summed for each range of positions, then carried on from range to
    range, a row each, and last within each range; so no task sees all events.
    Without a limit nothing is sorted.  Scans apply their limits in the reader.
    """
    is_file = F.col(kind_col) == "file"
    counted = {}
    if limits.max_files is not None:
        counted["files"] = (F.when(is_file, 1).otherwise(0), limits.max_files, F.lit(True))
    if limits.max_directories is not None:
        counted["directories"] = (F.when(~is_file, 1).otherwise(0), limits.max_directories, F.lit(True))
    if limits.max_total_size is not None:
        counted["bytes"] = (F.when(is_file, F.col(size_col)).otherwise(0), limits.max_total_size, is_file)
    if not counted:
        return events
    narrow = events.select(pos_col, kind_col, size_col).withColumn("__range", _ranged(events, pos_col))
    totals = narrow.groupBy("__range").agg(*(F.sum(value).alias(f"__{name}") for name, (value, _, _) in counted.items()))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = totals.select("__range", *(F.coalesce(F.sum(f"__{name}").over(earlier), F.lit(0)).alias(f"__{name}") for name in counted))
    upto = Window.partitionBy("__range").orderBy(pos_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tripped = F.lit(False)
    for name, (value, most, applies) in counted.items():
        tripped = tripped | (applies & (F.col(f"__{name}") + F.sum(value).over(upto) > most))
    stop = narrow.join(F.broadcast(carried), "__range").withColumn("__trips", tripped).where("__trips").agg(F.min(pos_col).alias("__stop"))
    return events.join(F.broadcast(stop), F.col("__stop").isNull() | (F.col(pos_col) < F.col("__stop")), "left_semi")
