"""Nearest neighbours from pair distances, and curves over k."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import ordered_index
from ..plans.storage import materialize
from .distance import FLOW, euclid, in_reach, measures, symmetric

#: Points that a first reach is guessed from (it changes the work, not the result), and how much the reach grows in each round.
GUESS, GROW = 1000, 1.6


def nearest(pairs: DataFrame, k: int, whole: bool = True) -> DataFrame:
    """(ref, rank, nn, distance): the k nearest by (distance, id). whole: distances are cut to whole numbers first."""
    d = F.col("d").cast("int") if whole else F.col("d").cast("double")
    both = symmetric(pairs).select(F.col("i").alias("ref"), F.col("j").alias("nn"), d.alias("distance"))
    w = Window.partitionBy("ref").orderBy("distance", "nn")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest_in_cells(points: DataFrame, key: str, columns: list[str], d: Column, k: int, slack: float = 0.0) -> DataFrame:
    """(ref, rank, nn, distance): the k nearest by (d, key) of each row, without making all pairs.

    d is an expression over columns suffixed _i and _j, in which no column differs by more than d + slack. Rows look
    around themselves within a reach; those that find k others there are done, the others look further in
    the next round. The reach starts small, so that dense places are done before sparse ones look far. A row of
    fewer than k others ends with all of them. Rows with a null column have no neighbours and are none.
    """
    p = materialize(points.select(key, *columns).dropna(), "knn-points")
    spans = p.agg(F.count("*").alias("n"), *[f(c).cast("double").alias(f"{m}{i}") for i, c in enumerate(columns) for m, f in (("a", F.min), ("b", F.max))]).first()
    n = spans["n"]
    most = sum((spans[f"b{i}"] or 0) - (spans[f"a{i}"] or 0) for i in range(len(columns))) * 2 + 2 * slack + 1  # more than any distance can be
    reach = min(_first_reach(p, columns, k, n), most) if n > k else most
    rest, done, ready = p, None, 0
    while True:
        near = in_reach(rest, p, key, columns, d, reach, slack).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("d", "j"))).alias("near"))
        found = materialize(near.filter(F.size("near") >= k if reach < most else F.lit(True)).select(F.col("i").alias("ref"), F.slice("near", 1, k).alias("near")), "knn-found")
        done = found if done is None else done.unionByName(found)
        ready += found.count()
        if reach >= most or ready == n:
            break
        rest = p.join(done.select(F.col("ref").alias(key)), key, "left_anti")
        reach = min(most, reach * GROW)
    return done.select("ref", F.posexplode("near").alias("rank", "e")).select("ref", (F.col("rank") + 1).alias("rank"), F.col("e.j").alias("nn"), F.col("e.d").alias("distance"))


def _first_reach(p: DataFrame, columns: list[str], k: int, n: int) -> float:
    """About the distance to the k-th neighbour of half the points, from GUESS points."""
    x = np.array([tuple(float(v) for v in r) for r in p.select(*columns).orderBy(F.xxhash64(*columns)).limit(GUESS).collect()])
    if len(x) < 2:
        return 1.0
    far = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))
    place = min(len(x) - 1, max(1, round(k * len(x) / n)))
    kth = float(np.quantile(np.sort(far, axis=1)[:, place], 0.5))
    return max(1e-9, kth * min(1.0, k * len(x) / n / place) ** (1 / len(columns)) * 1.4)


def nearest_flows(flows: DataFrame, k: int, measure: str = "manhattan", whole: bool = True) -> DataFrame:
    """M1: the k nearest flows by one of the measures manhattan, manhattan_exact, chebyshev and euclid4d, in which no end can be farther apart than the flows."""
    d = measures()[measure]
    return nearest_in_cells(flows, "flow_id", FLOW, d.cast("int") if whole else d.cast("double"), k, slack=1.5)


def nearest_vectors(points: DataFrame, key: str, columns: list[str], k: int) -> DataFrame:
    """M2: the k nearest by Euclidean distance over columns."""
    return nearest_in_cells(points, key, columns, euclid(columns), k)


def with_self(knn: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Each point as its own neighbour of rank 0."""
    return knn.unionByName(ids.select(F.col(key).alias("ref"), F.col(key).alias("nn"), F.lit(0).cast(dict(knn.dtypes)["distance"]).alias("distance"), F.lit(0).alias("rank")))


def wide(knn: DataFrame, ids: DataFrame, key: str, k: int) -> DataFrame:
    """One row for each id with NN1..NNk; null where it has fewer neighbours."""
    cells = knn.groupBy("ref").agg(*[F.max(F.when(F.col("rank") == r, F.col("nn"))).alias(f"NN{r}") for r in range(1, k + 1)])
    return ids.select(F.col(key).alias("ref")).join(cells, "ref", "left")


def distance_rows(knn: DataFrame, k: int) -> DataFrame:
    """NN1..NNk as distances."""
    return knn.groupBy("ref").agg(*[F.max(F.when(F.col("rank") == r, F.col("distance"))).alias(f"NN{r}") for r in range(1, k + 1)])


def kth_distances(knn: DataFrame, k: int, most: float = 99999) -> DataFrame:
    """(place, distance) of the k-th neighbours below `most`, in ascending order."""
    rows = knn.filter((F.col("rank") == k) & (F.col("distance") < most)).select("ref", "distance")
    placed = ordered_index(rows, [F.col("distance"), F.col("ref")], "_i", "kth-distances")
    return placed.select((F.col("_i") + 1).cast("int").alias("place"), "distance")


def expected_ratio(k: int) -> float:
    """R_k of randomly spread points; 1.000018 where doubles overflow."""
    try:
        f = k * math.factorial(2 * k) * math.sqrt(math.pi) / (2.0**k * float(math.factorial(k))) ** 2
        r = (k + 1 - ((2 * k + 1) / (2 * k)) ** 2 * f * f) / (k - f * f)
    except OverflowError:
        return 1.000018
    return r if math.isfinite(r) else 1.000018


def ratio_curve(knn: DataFrame, k_max: int) -> DataFrame:
    """(k, rkd) for k < k_max: growth of the variance of k-th distances against the expected."""
    var = knn.filter(F.col("rank") <= k_max).groupBy(F.col("rank").alias("k")).agg(F.var_samp(F.col("distance").cast("double")).alias("v"))
    after = Window.orderBy("k")  # k_max rows
    expected = F.element_at(F.array(*[F.lit(expected_ratio(k)) for k in range(1, k_max + 1)]), F.col("k"))
    return var.withColumn("n", F.lead("v").over(after)).filter(F.col("k") < k_max).select("k", (F.col("n") / F.nullif(F.col("v"), F.lit(0.0)) / expected).alias("rkd"))
