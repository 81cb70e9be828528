"""Seeded synthetic flows with known clusters. Draws are hashes of seed and id, so that reruns agree on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) that depends on seed and ids only."""
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, *ids: Column) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, *ids))) * F.cos(2 * math.pi * uniform(seed + 1, *ids))


def clustered_flows(spark: SparkSession, clusters: int, noise: int, side: float = 10_000.0, sizes: tuple[int, int] = (3, 50), seed: int = 1) -> DataFrame:
    """flow_id, cluster_id (0 for noise), ox, oy, dx, dy.

    A cluster starts in a random ellipse and goes one way, with jitter in length and angle; noise flows are 500 to 2000 long.
    """
    c = F.col("cluster_id")
    size = (F.lit(sizes[0]) + F.floor(uniform(seed, c) * (sizes[1] - sizes[0] + 1))).cast("int")
    rows = spark.range(1, clusters + 1).withColumnRenamed("id", "cluster_id").withColumn("n", F.explode(F.sequence(F.lit(1), size)))
    n = F.col("n")
    r, phi = F.sqrt(uniform(seed + 2, c, n)), uniform(seed + 3, c, n) * 2 * math.pi
    wide, high = 100 + 400 * uniform(seed + 4, c), 100 + 400 * uniform(seed + 5, c)
    x, y = uniform(seed + 6, c) * side + r * wide * F.cos(phi), uniform(seed + 7, c) * side + r * high * F.sin(phi)
    angle = uniform(seed + 8, c) * 2 * math.pi + normal(seed + 9, c, n) * 0.05
    length = (1000 + 3000 * uniform(seed + 11, c)) + normal(seed + 12, c, n) * 50
    flows = rows.select("cluster_id", "n", x.alias("ox"), y.alias("oy"), (x + length * F.cos(angle)).alias("dx"), (y + length * F.sin(angle)).alias("dy"))
    m = F.col("id")
    nx, ny, na, nl = uniform(seed + 14, m) * side, uniform(seed + 15, m) * side, uniform(seed + 16, m) * 2 * math.pi, 500 + 1500 * uniform(seed + 17, m)
    lone = spark.range(noise).select(F.lit(0).cast("long").alias("cluster_id"), m.alias("n"), nx.alias("ox"), ny.alias("oy"), (nx + nl * F.cos(na)).alias("dx"), (ny + nl * F.sin(na)).alias("dy"))
    from ..plans.skew import ordered_index

    both = flows.select("cluster_id", F.col("n").cast("long").alias("n"), "ox", "oy", "dx", "dy").unionByName(lone)
    return ordered_index(both, [F.when(F.col("cluster_id") == 0, None).otherwise(F.col("cluster_id")), F.col("n")], "flow_id", "synth").withColumn("flow_id", F.col("flow_id") + 1).drop("n")


def network_flows(edges: DataFrame, clusters: int, per_cluster: int, noise: int, seed: int = 1) -> DataFrame:
    """Y2: flows between places on the edges of a network: flow_id, cluster_id, origin_edge, origin_t, dest_edge, dest_t.

    A cluster goes from places on one edge and those that touch it to the same around the edge that is farthest from it; noise joins any two edges.
    """
    spark = edges.sparkSession
    from ..plans.skew import ordered_index
    from ..plans.storage import materialize

    e = materialize(ordered_index(edges.select("id", "source", "target", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y")), [F.col("id")], "at", "synth-edges"), "synth-edges")
    n = e.count()
    seeds = spark.range(1, clusters + 1).select(F.col("id").alias("cluster_id"), F.floor(uniform(seed, F.col("id")) * n).cast("long").alias("at")).join(e.select("at", F.col("id").alias("edge"), F.col("x").alias("x0"), F.col("y").alias("y0")), "at")
    far = (F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0"))
    ends = seeds.join(e, F.lit(True)).groupBy("cluster_id", "edge").agg(F.max_by("id", F.struct(far, -F.col("id"))).alias("far_edge"))  # seeds times edges

    def places(col: str, name: str, s: int) -> DataFrame:
        a = ends.select("cluster_id", F.col(col).alias("edge")).join(edges.select(F.col("id").alias("edge"), F.col("source").alias("u"), F.col("target").alias("v")), "edge")
        near = a.join(edges.select("id", "source", "target"), F.col("source").isin(F.col("u"), F.col("v")) | F.col("target").isin(F.col("u"), F.col("v")))
        pool = near.groupBy("cluster_id").agg(F.sort_array(F.collect_set("id")).alias("pool"))
        rows = pool.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(per_cluster))))
        pick = F.element_at("pool", (F.floor(uniform(s, F.col("cluster_id"), F.col("n")) * F.size("pool")) + 1).cast("int"))
        return rows.select("cluster_id", "n", pick.alias(f"{name}_edge"), uniform(s + 1, F.col("cluster_id"), F.col("n")).alias(f"{name}_t"))

    flows = places("edge", "origin", seed + 1).join(places("far_edge", "dest", seed + 3), ["cluster_id", "n"])
    ids = e.select("at", "id")
    any_edge = lambda s: F.floor(uniform(s, F.col("n")) * n).cast("long")
    lone = spark.range(noise).select(F.col("id").alias("n")).select("n", any_edge(seed + 5).alias("a"), any_edge(seed + 6).alias("b"))
    lone = lone.join(ids.select(F.col("at").alias("a"), F.col("id").alias("origin_edge")), "a").join(ids.select(F.col("at").alias("b"), F.col("id").alias("dest_edge")), "b")
    lone = lone.select(F.lit(0).cast("long").alias("cluster_id"), F.col("n").cast("int").alias("n"), "origin_edge", uniform(seed + 7, F.col("n")).alias("origin_t"), "dest_edge", uniform(seed + 8, F.col("n")).alias("dest_t"))
    both = flows.unionByName(lone)
    return ordered_index(both, [F.when(F.col("cluster_id") == 0, None).otherwise(F.col("cluster_id")), F.col("n")], "flow_id", "synth").withColumn("flow_id", F.col("flow_id") + 1).drop("n")


def published_set(points_o: DataFrame, points_d: DataFrame, clusters: DataFrame) -> DataFrame:
    """(flow_id, ox, oy, dx, dy, cluster_id) of points(flow_id, x, y) and clusters(cluster_id, id); flows in no list are noise."""
    o = points_o.select("flow_id", F.col("x").alias("ox"), F.col("y").alias("oy"))
    d = points_d.select("flow_id", F.col("x").alias("dx"), F.col("y").alias("dy"))
    return o.join(d, "flow_id").join(clusters.select(F.col("id").alias("flow_id"), "cluster_id"), "flow_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0)))
