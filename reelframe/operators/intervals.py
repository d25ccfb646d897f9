"""Interval operators: merge, complement, nearest and containing joins, greedy spacing.

Times are integers; intervals are half-open.  Every operator works per key, so that nothing falls
back to a nested loop or to one global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: int = 0, order: Sequence[str] = ()) -> DataFrame:
    """df with island: the number (from 1) of the group of intervals that overlap or lie at most gap apart."""
    w = W.partitionBy(*keys).orderBy(start, end, *order)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    return df.withColumn("opens_", opens).withColumn("island", F.sum("opens_").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("opens_")


def merge(df: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms", gap: int = 0, aggs: Sequence[Column] = (), order: Sequence[str] = ()) -> DataFrame:
    """One row per island: keys, start, end, and the given aggregates."""
    grouped = islands(df, keys, start, end, gap, order).groupBy(*keys, "island")
    return grouped.agg(F.min(start).alias(start), F.max(end).alias(end), *aggs).drop("island")


def complement(df: DataFrame, spans: DataFrame, keys: Sequence[str], start: str = "start_ms", end: str = "end_ms", duration: str = "duration_ms", whole_if_empty: bool = True) -> DataFrame:
    """What df leaves of [0, duration] for every row of spans (keys, duration): keys, start, end.

    An empty complement gives the whole span, unless whole_if_empty is off.
    """
    tail = spans.select(*keys, F.col(duration).alias(start), F.lit(None).cast("long").alias(end), F.col(duration).alias("limit_"))
    rows = df.select(*keys, start, end, F.lit(None).cast("long").alias("limit_")).unionByName(tail)
    # The closing row comes last: it sorts after every interval that starts before or at the end.
    w = W.partitionBy(*keys).orderBy(F.col("limit_").isNotNull(), start, F.col(end).asc_nulls_last())
    cursor = F.greatest(F.lit(0).cast("long"), F.coalesce(F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    limit = F.max("limit_").over(W.partitionBy(*keys))
    gaps = rows.select(*keys, cursor.alias("from_"), F.col(start).alias("to_"), limit.alias("all_"), F.col("limit_").isNotNull().alias("last_"))
    found = gaps.withColumn("n_", F.count_if(F.col("to_") > F.col("from_")).over(W.partitionBy(*keys)))
    keep = F.col("to_") > F.col("from_")
    if whole_if_empty:
        whole = F.col("last_") & (F.col("n_") == 0)
        return found.where((keep | whole) & F.col("all_").isNotNull()).select(*keys, F.when(whole, F.lit(0).cast("long")).otherwise(F.col("from_")).alias(start), F.when(whole, F.col("all_")).otherwise(F.col("to_")).alias(end))
    return found.where(keep & F.col("all_").isNotNull()).select(*keys, F.col("from_").alias(start), F.col("to_").alias(end))


def nearest(points: DataFrame, grid: DataFrame, keys: Sequence[str], t: str, at: str = "t", tolerance: int | None = None) -> DataFrame:
    """points with nearest: the closest grid time of the key, the earlier one of two as close; null if there is none or it is too far.

    Grid and points are merged and swept once by time; no pair is formed.
    """
    cols = points.columns
    marks = grid.select(*keys, F.col(at).alias("t_"), F.col(at).alias("g_"), F.lit(0).alias("side_"))
    both = points.withColumn("t_", F.col(t)).withColumn("g_", F.lit(None).cast("long")).withColumn("side_", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("t_", "side_")
    back = F.last("g_", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first("g_", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    swept = both.withColumn("back_", back).withColumn("ahead_", ahead).where("side_ = 1")
    closer = F.col("ahead_").isNull() | (F.col("t_") - F.col("back_") <= F.col("ahead_") - F.col("t_"))
    found = F.when(closer & F.col("back_").isNotNull(), F.col("back_")).otherwise(F.col("ahead_"))
    if tolerance is not None:
        found = F.when(F.abs(found - F.col("t_")) <= tolerance, found)
    return swept.select(*cols, found.alias("nearest"))


def containing(points: DataFrame, grid: DataFrame, keys: Sequence[str], t: str = "t", at: str = "t", carry: Sequence[str] = ("i",)) -> DataFrame:
    """points with the carried columns of the last grid row at or before them (as-of backward), null before the first."""
    cols = points.columns
    marks = grid.select(*keys, F.col(at).alias("t_"), F.struct(*carry).alias("g_"), F.lit(0).alias("side_"))
    empty = F.lit(None).cast(marks.schema["g_"].dataType)
    both = points.withColumn("t_", F.col(t)).withColumn("g_", empty).withColumn("side_", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy("t_", "side_").rowsBetween(W.unboundedPreceding, 0)
    swept = both.withColumn("held_", F.last("g_", ignorenulls=True).over(w)).where("side_ = 1")
    return swept.select(*cols, *(F.col(f"held_.{c}").alias(f"in_{c}") for c in carry))


def points_in(points: DataFrame, spans: DataFrame, keys: Sequence[str], t: str, start: str, end: str, width: int = 1 << 12) -> DataFrame:
    """Every (span, point) with start <= point < end.

    Both sides carry the stretch of time (of `width`) as an equi key, so a long key's points meet only the spans near them.
    """
    p = points.withColumn("slot_", F.floor(F.col(t) / F.lit(width))).alias("p")
    reach = F.sequence(F.floor(F.col(start) / F.lit(width)), F.floor((F.col(end) - 1) / F.lit(width)))
    s = spans.where(F.col(end) > F.col(start)).withColumn("slot_", F.explode(reach)).alias("s")
    cond = F.col("p.slot_") == F.col("s.slot_")
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    cond = cond & (F.col(f"p.{t}") >= F.col(f"s.{start}")) & (F.col(f"p.{t}") < F.col(f"s.{end}"))
    return s.join(p, cond).select(*(F.col(f"s.{c}") for c in spans.columns), *(F.col(f"p.{c}") for c in points.columns if c not in keys))


def spaced(times: Column, least: int, first: Column | None = None) -> Column:
    """Of a sorted array, the values that lie at least `least` after the last one accepted; `first` counts as accepted."""
    start = F.struct(F.array().cast("array<long>").alias("kept"), (F.lit(None) if first is None else first).cast("long").alias("last"))

    def step(acc: Column, t: Column) -> Column:
        take = acc["last"].isNull() | (t - acc["last"] >= least)
        return F.struct(F.when(take, F.concat(acc["kept"], F.array(t))).otherwise(acc["kept"]).alias("kept"), F.when(take, t).otherwise(acc["last"]).alias("last"))

    return F.aggregate(times, start, step, lambda acc: acc["kept"])


def sessions(df: DataFrame, keys: Sequence[str], t: str, gap: int, order: Sequence[str] = ()) -> DataFrame:
    """df with session: its number (from 1) per key; a pause of more than gap opens a new one."""
    w = W.partitionBy(*keys).orderBy(t, *order)
    opens = F.when(F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True)), 1).otherwise(0)
    return df.withColumn("opens_", opens).withColumn("session", F.sum("opens_").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("opens_")
