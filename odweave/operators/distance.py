"""Distances between flows, and joins that enumerate pairs in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance, flow_angle, rounded
from ..plans.storage import parallelism


def half_pairs(df: DataFrame, key: str, blocks: int | None = None) -> DataFrame:
    """All pairs of rows with key_i < key_j as columns suffixed _i and _j.

    Rows are dealt into blocks and blocks are paired by an equi-join, so that a pair of blocks is one
    task's work and no side is broadcast or sent everywhere.
    """
    b = blocks or max(2, round((2 * parallelism(df.sparkSession)) ** 0.5))
    cut = F.pmod(F.xxhash64(key), F.lit(b)).cast("int")
    left = df.select(*[F.col(c).alias(f"{c}_i") for c in df.columns], cut.alias("_a")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    right = df.select(*[F.col(c).alias(f"{c}_j") for c in df.columns], cut.alias("_b")).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    return left.join(right.hint("shuffle_hash"), ["_a", "_b"]).filter(F.col(f"{key}_i") < F.col(f"{key}_j")).drop("_a", "_b")


def _ends() -> tuple[Column, Column]:
    c = F.col
    return distance(c("ox_i"), c("oy_i"), c("ox_j"), c("oy_j")), distance(c("dx_i"), c("dy_i"), c("dx_j"), c("dy_j"))


def _length(s: str) -> Column:
    return distance(F.col(f"ox_{s}"), F.col(f"oy_{s}"), F.col(f"dx_{s}"), F.col(f"dy_{s}"))


def measures() -> dict[str, Column]:
    """Measures on half_pairs() of flows: manhattan (D5), manhattan_exact, chebyshev (D6), euclid4d (D7), length (D8), direction (D9), euclid4d_norm."""
    o, d = _ends()
    c = F.col
    dot = (c("dx_i") - c("ox_i")) * (c("dx_j") - c("ox_j")) + (c("dy_i") - c("oy_i")) * (c("dy_j") - c("oy_j"))
    li, lj = _length("i"), _length("j")
    return {
        "manhattan": rounded(o) + rounded(d),
        "manhattan_exact": o + d,
        "chebyshev": F.greatest(rounded(o), rounded(d)),
        "euclid4d": rounded(F.sqrt(o * o + d * d)),
        "length": rounded(F.abs(li - lj)),
        "direction": F.lit(1.0) - dot / F.nullif(li * lj, F.lit(0.0)),
        "euclid4d_norm": F.sqrt((o * o + d * d) / F.nullif(li * lj, F.lit(0.0))),
    }


def flow_pairs(flows: DataFrame, measure: str = "manhattan", name: str = "d") -> DataFrame:
    """(i, j, d) for i < j."""
    pairs = half_pairs(flows.select("flow_id", "ox", "oy", "dx", "dy"), "flow_id")
    return pairs.select(F.col("flow_id_i").alias("i"), F.col("flow_id_j").alias("j"), measures()[measure].alias(name))


FLOW = ["ox", "oy", "dx", "dy"]


def euclid(columns: list[str]) -> Column:
    """Euclidean distance over columns suffixed _i and _j."""
    return F.sqrt(sum(((F.col(f"{c}_i") - F.col(f"{c}_j")) * (F.col(f"{c}_i") - F.col(f"{c}_j")) for c in columns), F.lit(0.0)))


def in_reach(queries: DataFrame, points: DataFrame, key: str, columns: list[str], d: Column, reach: float, slack: float) -> DataFrame:
    """(i, j, d) of rows i of queries and other rows j of points with d <= reach, without making all pairs.

    No column may differ by more than d + slack. Space is cut into cells that wide, and each query meets the
    cells around its own; so a row's work is the rows near it, however many there are in all.
    """
    size = float(reach + slack) or 1.0
    cells = [F.floor(F.col(c) / size).alias(f"_c{n}") for n, c in enumerate(columns)]
    left = queries.select(*[F.col(c).alias(f"{c}_i") for c in (key, *columns)], *cells)
    for n in range(len(columns)):
        left = left.withColumn(f"_c{n}", F.explode(F.array(*[F.col(f"_c{n}") + o for o in (-1, 0, 1)])))
    right = points.select(*[F.col(c).alias(f"{c}_j") for c in (key, *columns)], *cells)
    met = left.join(right, [f"_c{n}" for n in range(len(columns))]).filter(F.col(f"{key}_i") != F.col(f"{key}_j"))
    return met.select(F.col(f"{key}_i").alias("i"), F.col(f"{key}_j").alias("j"), d.alias("d")).filter(F.col("d") <= reach)


def symmetric(pairs: DataFrame) -> DataFrame:
    """(i, j, d) both ways."""
    return pairs.select("i", "j", "d").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def rescaled(df: DataFrame, columns: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Columns scaled from their least and greatest value to [low, high]; null where all values are equal."""
    ends = df.agg(*[f(c).cast("double").alias(f"_{n}_{c}") for c in columns for n, f in (("a", F.min), ("b", F.max))])
    out = df.crossJoin(F.broadcast(ends))  # one row
    for c in columns:
        out = out.withColumn(c, low + (F.col(c) - F.col(f"_a_{c}")) / F.nullif(F.col(f"_b_{c}") - F.col(f"_a_{c}"), F.lit(0.0)) * (high - low))
    return out.select(*df.columns)


def geometric_pairs(flows: DataFrame, wrap: bool = False) -> DataFrame:
    """(i, j, d): distance, difference of angles and difference of lengths, each scaled to [0, 1], and added. wrap: angles differ by at most 180 degrees."""
    pairs = half_pairs(flows.select("flow_id", "ox", "oy", "dx", "dy"), "flow_id")
    angle = lambda s: flow_angle(F.col(f"ox_{s}"), F.col(f"oy_{s}"), F.col(f"dx_{s}"), F.col(f"dy_{s}"))
    da = F.abs(angle("i") - angle("j"))
    parts = pairs.select(F.col("flow_id_i").alias("i"), F.col("flow_id_j").alias("j"), measures()["manhattan"].cast("double").alias("far"), (F.least(da, 360 - da) if wrap else da).alias("turn"), F.abs(_length("i") - _length("j")).alias("grow"))
    return rescaled(parts, ["far", "turn", "grow"]).select("i", "j", (F.col("far") + F.col("turn") + F.col("grow")).alias("d"))


def vector_pairs(points: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(i, j, d) Euclidean over columns."""
    pairs = half_pairs(points.select(key, *columns), key)
    return pairs.select(F.col(f"{key}_i").alias("i"), F.col(f"{key}_j").alias("j"), euclid(columns).alias("d"))
