"""Joins and orderings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

#: A key is hot if it holds more than 1/HOT_KEYS of all rows; so at most HOT_KEYS keys are.
HOT_KEYS = 500


def attach(rows: DataFrame, dims: DataFrame, key: str, count: str, salt: Column) -> DataFrame:
    """rows with the columns of dims (one row for each key; `count` says how many rows have it), as a left join.

    Hot keys are at most HOT_KEYS, so their part of dims is broadcast; rows of hot keys and rows whose key
    is null pass through the shuffle under `salt`, an integer made from other columns, and so spread evenly.
    """
    total = dims.agg(F.sum(count)).first()[0] or 0
    values = [c for c in dims.columns if c not in (key, count)]
    hot = dims.filter(F.col(count) * HOT_KEYS > total).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = dims.filter(F.col(count) * HOT_KEYS <= total).select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_f"), F.struct(*values).alias("_cold"))
    kind = dict(rows.dtypes)[key]
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    free = F.col("_hot").isNotNull() | F.col(key).isNull()
    out = out.withColumn("_f", free.cast("int")).withColumn("_jk", F.when(free, salt.cast(kind)).otherwise(F.col(key)))
    out = out.join(cold, (F.col("_jk") == F.col("_cold_key")) & (F.col("_f") == F.col("_cold_f")), "left")
    one = F.coalesce("_hot", "_cold")
    return out.select(*[F.col(c) for c in rows.columns if c not in values], *[one[v].alias(v) for v in values])


def ordered_index(df: DataFrame, keys: list[Column], name: str, label: str) -> DataFrame:
    """df with a dense 0-based index in the order of keys, without a single-task window.

    Rows are range-partitioned and sorted, written once, and numbered by the count of earlier
    partitions plus the place within their own. What is gathered is a count for each partition.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    plain = df.select("*", *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    sort = [F.col(n).asc_nulls_last() for n in names]
    put = materialize(plain.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_m", F.monotonically_increasing_id()), label)
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = put.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return put.join(F.broadcast(starts), part == F.col("_p")).withColumn(name, F.col("_s") + place).drop("_p", "_s", "_m", *names)


def grouped_prefix(df: DataFrame, group: list[str], chunk: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of `value` over the earlier rows of its group, in the order of (chunk, *order).

    The running sum is made within chunks; sums of whole chunks are added. So no task holds a whole
    group, only one chunk of it or one row for each of its chunks.
    """
    rows = df.withColumn("_chunk", chunk).withColumn("_v", value)
    earlier = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_v").over(earlier), F.lit(0)))
    sums = df.groupBy(*group, chunk.alias("_chunk")).agg(F.sum(value).alias("_cv"))
    chunks = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_chunk").alias("_c"), F.coalesce(F.sum("_cv").over(chunks), F.lit(0)).alias("_off"))
    same = F.col("_chunk") == F.col("_c")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = rows.join(starts, same, "left")
    return out.withColumn(name, F.col("_in") + F.col("_off")).drop("_chunk", "_v", "_in", "_c", "_off", *[f"_g_{g}" for g in group])
