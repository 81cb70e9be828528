"""Counts over time, densified series, profiles and windows of flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import time_of_day, week_iso, weekday_monday


def count_variance(trips: DataFrame, cluster: str, part: Column) -> DataFrame:
    """A2: (cluster, variance) of a cluster's counts by day, hour and so on; null where it has one part."""
    return trips.groupBy(cluster, part.alias("_p")).agg(F.count("*").alias("n")).groupBy(cluster).agg(F.var_samp(F.col("n").cast("double")).alias("variance"))


def complete_counts(trips: DataFrame, part: Column, low: int, high: int, by: str) -> DataFrame:
    """(part, by, n) for every part from low to high and every value of `by` that occurs; 0 where there is no trip."""
    n = trips.groupBy(part.cast("int").alias("part"), by).agg(F.count("*").alias("n"))
    keys = trips.select(by).distinct().withColumn("part", F.explode(F.sequence(F.lit(low), F.lit(high))))
    return keys.join(n, ["part", by], "left").select("part", by, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def complete_days(trips: DataFrame, ts: str, by: str) -> DataFrame:
    """(day, by, n) for every day from the first to the last."""
    n = trips.groupBy(F.to_date(ts).alias("day"), by).agg(F.count("*").alias("n"))
    span = trips.agg(F.min(F.to_date(ts)).alias("a"), F.max(F.to_date(ts)).alias("b"))
    days = span.filter("a IS NOT NULL").select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    # Days times values of `by`, both from aggregates.
    keys = days.crossJoin(trips.select(by).distinct())
    return keys.join(n, ["day", by], "left").select("day", by, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def by_minute(trips: DataFrame, ts: str, by: str) -> DataFrame:
    return complete_counts(trips, F.minute(ts), 0, 59, by)


def by_hour(trips: DataFrame, ts: str, by: str) -> DataFrame:
    return complete_counts(trips, F.hour(ts), 0, 23, by)


def by_weekday(trips: DataFrame, ts: str, by: str) -> DataFrame:
    return complete_counts(trips, weekday_monday(F.col(ts)), 1, 7, by)


def direction_profile(trips: DataFrame, cluster: str, outward: list[int], inward: list[int]) -> DataFrame:
    """(direction, hour, n) where clusters are tagged by two lists; others go."""
    tag = F.when(F.col(cluster).isin(outward), "outward").when(F.col(cluster).isin(inward), "inward")
    return trips.withColumn("tag", tag).filter("tag IS NOT NULL").groupBy(F.col("tag").alias("tag"), F.hour("start_datetime").alias("hour")).agg(F.count("*").alias("n"))


def availability_series(snapshots: DataFrame) -> DataFrame:
    """Q6, A4: (time_stamp, cluster, count)."""
    return snapshots.groupBy("time_stamp", "cluster").agg(F.count("*").alias("count"))


def availability_profile(series: DataFrame, without: list[int] | None = None) -> DataFrame:
    """(cluster, time_of_day, week, mean_count, mean_rel) with counts relative to their cluster's largest."""
    rel = series.withColumn("rel", F.col("count") / F.max("count").over(Window.partitionBy("cluster")))
    if without:
        rel = rel.filter(~F.col("cluster").isin(without))
    t = F.col("time_stamp")
    return rel.groupBy("cluster", time_of_day(t).alias("time_of_day"), week_iso(t).alias("week")).agg(F.avg("count").alias("mean_count"), F.avg("rel").alias("mean_rel"))


def windows_of_ids(df: DataFrame, key: str, step: int) -> DataFrame:
    """Rows once for each window [w * step, (w + 1) * step] of ids (both ends belong to it), with window, org_id and ids from 1."""
    w = F.floor(F.col(key) / step).cast("long")
    both = F.when((F.col(key) % step == 0) & (F.col(key) > 0), F.array(w - 1, w)).otherwise(F.array(w))
    rows = df.withColumn("window", F.explode(both)).withColumn("org_id", F.col(key))
    return rows.withColumn(key, F.row_number().over(Window.partitionBy("window").orderBy("org_id")))


def filtered_flows(trips: DataFrame, ts: str, key: str, weeks: list[int] | None = None, hours: list[int] | None = None, weekdays: list[int] | None = None, least: float = 0.0, length: str = "trip_distance") -> DataFrame:
    """Flows of given weeks, hours and weekdays and of a least length, with dense flow_id from 1 by start and key."""
    from ..functions.calendar import week_simple
    from ..plans.skew import ordered_index

    t = F.col(ts)
    rows = trips.filter(F.col(length) >= least)
    for values, part in ((weeks, week_simple(t)), (hours, F.hour(t)), (weekdays, weekday_monday(t))):
        rows = rows.filter(part.isin(values)) if values else rows
    return ordered_index(rows, [t, F.col(key)], "_i", "flows").withColumn("flow_id", F.col("_i") + 1).drop("_i")
