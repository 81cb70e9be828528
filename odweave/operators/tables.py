"""Changes of tables and summaries by group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import ordered_index


def altered(df: DataFrame, add: dict[str, Column] | None = None, drop: list[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """K8: columns added, then dropped, then renamed. Names that aren't there are left alone."""
    return df.withColumns(add or {}).drop(*(drop or [])).withColumnsRenamed(rename or {})


def name_matches(name: Column, like: list[str], unlike: list[str] | None = None) -> Column:
    """Whether a string matches all SQL patterns of `like` and none of `unlike`; null for a null."""
    tests = [name.like(p) for p in like] + [~name.like(p) for p in unlike or []]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def first_of_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each group: the first in order (nulls first); of equal ones one with the least other columns."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*[c if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def group_ids(df: DataFrame, keys: list[str], name: str = "group_id") -> DataFrame:
    """Df with the number of its group, dense from 1 in the order of the keys (nulls last)."""
    groups = ordered_index(df.select(*keys).distinct(), [F.col(k) for k in keys], "_i", "group-ids")
    known = groups.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], (F.col("_i") + 1).alias(name))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)])
    return df.join(known, same, "left").select(*df.columns, name)


def group_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, mean and maximum of a value by group."""
    return df.groupBy(*keys).agg(F.median(value).alias("median"), F.avg(value).alias("mean"), F.max(value).alias("max"))


def column_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, minimum, q1, median, q3, maximum, mean) of numeric columns; nulls don't count.

    Quartiles are exact, with linear interpolation: the values are numbered in order, and the few places wanted are read.
    """
    out = None
    for c in columns:
        rows = ordered_index(df.select(F.col(c).cast("double").alias("v")).filter("v IS NOT NULL"), [F.col("v")], "at", "summary")
        total = rows.agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
        n = F.col("n")
        near = rows.crossJoin(F.broadcast(total))  # one row
        near = near.filter(reduce(lambda a, b: a | b, [F.col("at") == f((n - 1) * q) for q in (0.0, 0.25, 0.5, 0.75, 1.0) for f in (F.floor, F.ceil)]))

        def at(q: float, n: Column = n) -> Column:
            place = (n - 1) * q
            low, high = (F.max(F.when(F.col("at") == f(place), F.col("v"))) for f in (F.floor, F.ceil))
            return low + (high - low) * F.max(place - F.floor(place))

        row = near.agg(F.lit(c).alias("column"), F.max("n").alias("n"), *[at(q).alias(a) for a, q in (("minimum", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("maximum", 1.0))], F.max("mean").alias("mean"))
        out = row if out is None else out.unionByName(row)
    return out


def over_group_maximum(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Df with norm_<column>, its share of the group's largest value; null where that is 0 or null."""
    most = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[F.max(c).alias(f"_max_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(most, same).select(*df.columns, *[(F.col(c) / F.nullif(F.col(f"_max_{c}"), F.lit(0))).alias(f"norm_{c}") for c in columns])


def distinct_sorted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of some columns, in order."""
    return df.select(*columns).distinct().orderBy(*columns)


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """A row for each row and column, with the column's name and value; nulls stay."""
    return df.unpivot(keys, columns, name, value)


def melted(pairs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """R2: (from, to, distance) of a whole distance matrix, both ways and with a diagonal of 0, from its half pairs (i, j, d)."""
    both = pairs.select(F.col("i").alias("from"), F.col("j").alias("to"), F.col("d").alias("distance"))
    back = pairs.select(F.col("j").alias("from"), F.col("i").alias("to"), F.col("d").alias("distance"))
    own = ids.select(F.col(key).alias("from"), F.col(key).alias("to"), F.lit(0).cast(dict(pairs.dtypes)["d"]).alias("distance"))
    return both.unionByName(back).unionByName(own)
