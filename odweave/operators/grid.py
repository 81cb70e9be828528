"""Extents of any size met in grid cells: each is filed at the level of its own size.

The cells of level L are 2^L wide. An extent's own level is that whose cells are at least half as wide as its longer
side, so it meets at most nine of them, however large it is. Two extents meet at the coarser of their two levels: each is
filed at its own level and looks into those above it that the other table uses. So rows for each extent are bounded
by nine times the number of levels, which is the number of powers of two between the smallest and the largest size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import parallelism

#: Rows that look into a cell in one part.
CROWD = 10_000
#: The finest level; points and smaller extents are filed there.
FINEST = -30


def box(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    return F.struct(x_min.cast("double").alias("x_min"), y_min.cast("double").alias("y_min"), x_max.cast("double").alias("x_max"), y_max.cast("double").alias("y_max"))


def level_of(extent: Column) -> Column:
    side = F.greatest(extent["x_max"] - extent["x_min"], extent["y_max"] - extent["y_min"])
    return F.when(side > 2.0**FINEST, F.ceil(F.log2(side)) - 1).otherwise(F.lit(FINEST)).cast("int")


def levels(rows: DataFrame, extent: Column) -> list[int]:
    """The levels that rows use: exponents of two, so few."""
    return sorted(r[0] for r in rows.filter(extent["x_min"].isNotNull()).select(level_of(extent)).distinct().collect())


def filed(rows: DataFrame, extent: Column, level: Column) -> DataFrame:
    """rows once for each cell (_level, _u, _v) of a level that their extent meets; extents without a place go."""
    out = rows.withColumns({"_box": extent, "_level": level}).filter("_box.x_min IS NOT NULL AND _box.y_min IS NOT NULL AND _level IS NOT NULL")
    size = F.pow(F.lit(2.0), F.col("_level"))
    span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(f"_box.{lo}") / size), F.floor(F.col(f"_box.{hi}") / size)))
    return out.withColumn("_u", span("x_min", "x_max")).withColumn("_v", span("y_min", "y_max")).drop("_box")


def looking(rows: DataFrame, extent: Column, above: list[int], strictly: bool = False) -> DataFrame:
    """rows in the cells of each of these levels from their own level up (strictly: above it)."""
    own = level_of(extent)
    wanted = F.filter(F.array(*[F.lit(x) for x in above]).cast("array<int>"), lambda x: x > own if strictly else x >= own)
    return filed(rows.withColumn("_look", F.explode(wanted)), extent, F.col("_look")).drop("_look")


def crowding(a: DataFrame, extent_a: Column, b: DataFrame, extent_b: Column) -> tuple[list[int], Column]:
    """The levels that b uses, and into how many parts the rows of a that look into a cell of `_level` are dealt.

    Where a level has few cells, all rows of a look into them, and each cell would be one task's work.
    """
    own = levels(b, extent_b)
    ends = a.agg(F.count("*"), *[f(extent_a[c]) for c, f in (("x_min", F.min), ("y_min", F.min), ("x_max", F.max), ("y_max", F.max))]).first()
    n, (x0, y0, x1, y1) = ends[0], [float(v or 0) for v in ends[1:]]
    cells = {x: (math.floor(x1 / 2.0**x) - math.floor(x0 / 2.0**x) + 1) * (math.floor(y1 / 2.0**x) - math.floor(y0 / 2.0**x) + 1) for x in own}
    most = parallelism(a.sparkSession, 4)
    crowded = {x: min(most, math.ceil(n / c / CROWD)) for x, c in cells.items() if n / c > CROWD}
    parts = F.lit(1)
    for x, k in crowded.items():
        parts = F.when(F.col("_level") == x, F.lit(k)).otherwise(parts)
    return own, parts


def _met(look: DataFrame, extent: Column, file: DataFrame, parts: Column) -> DataFrame:
    """look and file joined by their cells, the rows of look in a crowded cell by parts. Neither side is broadcast: rows for each extent are many more than the table's size tells."""
    dealt = look.withColumn("_part", F.pmod(F.xxhash64(extent), parts).cast("int"))
    spread = file.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.join(spread.hint("merge"), ["_level", "_u", "_v", "_part"]).drop("_part")


def points_and_extents(points: DataFrame, x: str, y: str, rows: DataFrame, extent: Column) -> DataFrame:
    """points joined with the rows into whose cells they fall and whose extents hold them. No names in common."""
    at = box(F.col(x), F.col(y), F.col(x), F.col(y))
    own, parts = crowding(points, at, rows, extent)
    met = _met(looking(points, at, own), at, filed(rows.withColumn("_in", extent), extent, level_of(extent)), parts)
    return met.filter((F.col(x) >= F.col("_in.x_min")) & (F.col(x) <= F.col("_in.x_max")) & (F.col(y) >= F.col("_in.y_min")) & (F.col(y) <= F.col("_in.y_max"))).drop("_level", "_u", "_v", "_in")


def meeting(a: DataFrame, extent_a: Column, b: DataFrame, extent_b: Column) -> DataFrame:
    """Pairs of rows of a and b whose extents meet, each once. No names in common."""
    (in_b, parts_b), (in_a, parts_a) = crowding(a, extent_a, b, extent_b), crowding(b, extent_b, a, extent_a)
    over_b = _met(looking(a, extent_a, in_b), extent_a, filed(b, extent_b, level_of(extent_b)), parts_b)
    over_a = _met(looking(b, extent_b, in_a, strictly=True), extent_b, filed(a, extent_a, level_of(extent_a)), parts_a)
    meet = (extent_a["x_min"] <= extent_b["x_max"]) & (extent_b["x_min"] <= extent_a["x_max"]) & (extent_a["y_min"] <= extent_b["y_max"]) & (extent_b["y_min"] <= extent_a["y_max"])
    size = F.pow(F.lit(2.0), F.col("_level"))
    # Of the cells that both meet, the pair counts in the first.
    once = (F.col("_u") == F.floor(F.greatest(extent_a["x_min"], extent_b["x_min"]) / size)) & (F.col("_v") == F.floor(F.greatest(extent_a["y_min"], extent_b["y_min"]) / size))
    columns = [*a.columns, *b.columns]
    return over_b.filter(meet & once).select(*columns).unionByName(over_a.filter(meet & once).select(*columns))
