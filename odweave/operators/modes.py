"""Q5: the densest places of each cluster's origins and destinations, with no cluster in one task.

A kernel density on a grid is a sum over points, so parts of a cluster give partial densities that are added up. The
bandwidths need the cluster's spread and quartiles, which come from sums and from running counts of its values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.skew import attach, grouped_prefix
from ..plans.storage import materialize

#: Rows of a cluster in one part, cells of the grid on each side, and chunks of a running count.
PART, GRID, CHUNKS = 65_536, 50, 256
AXES = ("ox", "oy", "dx", "dy")


def quartiles(values: DataFrame) -> DataFrame:
    """(cluster, axis, q25, q75) of values(cluster, axis, v), between the two nearest values where a quartile falls between them."""
    counts = values.groupBy("cluster", "axis", "v").agg(F.count("*").alias("n"))
    ends = values.groupBy("cluster", "axis").agg(F.count("*").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))
    rows = materialize(counts.join(ends, ["cluster", "axis"]), "mode-values")
    chunk = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * (CHUNKS - 1))).otherwise(F.lit(0))
    ranked = grouped_prefix(rows, ["cluster", "axis"], chunk, [F.col("v")], F.col("n"), "before")

    def at(share: float) -> Column:
        h = F.lit(share) * (F.col("total") - 1)
        value = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col("v")))
        low, high, t = value(F.floor(h)), value(F.ceil(h)), F.max(h - F.floor(h))
        return low + (high - low) * t

    return ranked.groupBy("cluster", "axis").agg(at(0.25).alias("q25"), at(0.75).alias("q75"))


def bandwidths(values: DataFrame) -> DataFrame:
    """(cluster, axis, n, low, high, width): 0.9 * min(sd, IQR / 1.34) * n^-0.2; where that is 0 the sd, the value itself or 1 takes the minimum's place."""
    of = values.groupBy("cluster", "axis").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))
    both = of.join(quartiles(values), ["cluster", "axis"])
    sd, first = F.when(F.col("low") == F.col("high"), F.lit(0.0)).otherwise(F.col("sd")), F.abs("low")
    least = F.least(sd, (F.col("q75") - F.col("q25")) / 1.34)
    base = F.when(least != 0, least).when(sd != 0, sd).when(first != 0, first).otherwise(F.lit(1.0))
    return both.select("cluster", "axis", "n", "low", "high", (0.9 * base * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("width"))


def _densities(grid: int):  # noqa: ANN202
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]

        def kernel(axis: str) -> np.ndarray:
            places = np.linspace(one[f"low_{axis}"], one[f"high_{axis}"], grid)
            return np.exp(-0.5 * ((places[:, None] - pdf[axis].to_numpy(float)[None, :]) / one[f"width_{axis}"]) ** 2)

        return pd.DataFrame({"cluster": [one["cluster"]] * 2, "end": ["o", "d"], "density": [(kernel("ox") @ kernel("oy").T).ravel(), (kernel("dx") @ kernel("dy").T).ravel()]})

    return run


def representative_lines(trips: DataFrame, cluster: str, grid: int = GRID, part: int = PART) -> DataFrame:
    """Q5: (cluster, ox, oy, dx, dy): of a grid over each cluster's origins, and of one over its destinations, the place of highest Gaussian kernel density; of equal ones the first by x, then y.

    Rows with a null in any of these columns go. A cluster of one place has that place.
    """
    rows = materialize(trips.select(F.col(cluster).cast("long").alias("cluster"), *[F.col(a).cast("double").alias(a) for a in AXES]).dropna().withColumn("_r", F.monotonically_increasing_id()), "mode-rows")
    values = rows.select("cluster", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in AXES])).alias("s")).select("cluster", "s.*")
    figures = bandwidths(values).groupBy("cluster").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{c}_{a}") for a in AXES for c in ("low", "high", "width")])
    figures = materialize(figures.withColumn("_parts", F.ceil(F.col("n") / part).cast("int")), "mode-figures")
    dealt = attach(rows, figures, "cluster", "n", F.xxhash64("_r")).withColumn("_part", F.pmod(F.xxhash64("_r"), F.col("_parts")))
    parts = dealt.groupBy("cluster", "_part").applyInPandas(_densities(grid), "cluster long, end string, density array<double>")
    cells = parts.select("cluster", "end", F.posexplode("density").alias("cell", "p")).groupBy("cluster", "end", "cell").agg(F.sum("p").alias("p"))
    top = cells.groupBy("cluster").agg(*[F.max(F.when(F.col("end") == e, F.struct("p", (-F.col("cell")).alias("c")))).alias(f"_{e}") for e in "od"])
    both = top.join(figures, "cluster")
    place = lambda a, e, cell: F.col(f"low_{a}") + cell * (F.col(f"high_{a}") - F.col(f"low_{a}")) / (grid - 1)  # noqa: E731, ARG005
    cell = {e: -F.col(f"_{e}.c") for e in "od"}
    return both.select("cluster", *[place(a, a[0], F.floor(cell[a[0]] / grid) if a[1] == "x" else cell[a[0]] % grid).alias(a) for a in AXES])
