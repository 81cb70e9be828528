"""Deterministic inputs of the registered queries, derived from whole driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the grid network in nodes, and length of its edges in metres.
SIDE, STEP = 20, 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow_id, ox, oy, dx, dy (whole numbers) and truth, from embeddings."""
    at = lambda i: F.round(F.col("embedding")[i].cast("double") * 10000).cast("int")
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("flow_id"), at(0).alias("ox"), at(1).alias("oy"), at(2).alias("dx"), at(3).alias("dy"), F.col("label").alias("truth"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips on the grid's extent, from events."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        e.alias("trip_id"), ((e * 7919 + u * 31) % 19001).alias("ox"), ((e * 6271 + 17) % 19001).alias("oy"), ((e * 4001 + u * 101) % 19001).alias("dx"), ((e * 3571 + 5) % 19001).alias("dy"),
        F.col("ts").cast("timestamp_ntz").alias("start_datetime"), F.col("event_type").alias("direction"), (u % 10 + 1).cast("int").alias("cluster"), u.alias("user_id"), F.col("value"),
    )


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots (time_stamp by the minute, cluster), from events."""
    return table(spark, sf_dir, "events").select(F.date_trunc("minute", "ts").alias("time_stamp"), (F.col("user_id") % 10 + 1).cast("int").alias("cluster"))


def grid_nodes(spark: SparkSession, side: int = SIDE, step: int = STEP) -> DataFrame:
    r, c = F.floor(F.col("id") / side), F.col("id") % side
    return spark.range(side * side).select((F.col("id") + 1).alias("node"), (c * step).cast("double").alias("x"), (r * step).cast("double").alias("y"))


def grid_edges(spark: SparkSession, side: int = SIDE, step: int = STEP) -> DataFrame:
    """Edges (id, source, target, m, x1, y1, x2, y2): the horizontal ones first."""
    r, c = F.floor(F.col("id") / side).cast("long"), F.col("id") % side
    node = spark.range(side * side).select(r.alias("r"), c.alias("c"), (F.col("id") + 1).alias("source"))
    h = node.filter(F.col("c") < side - 1).select((F.col("r") * (side - 1) + F.col("c") + 1).alias("id"), "source", (F.col("source") + 1).alias("target"), "r", "c", F.lit(1).alias("dc"), F.lit(0).alias("dr"))
    v = node.filter(F.col("r") < side - 1).select((F.lit(side * (side - 1)) + F.col("r") * side + F.col("c") + 1).alias("id"), "source", (F.col("source") + side).alias("target"), "r", "c", F.lit(0).alias("dc"), F.lit(1).alias("dr"))
    m = lambda x: (x * step).cast("double")
    return h.unionByName(v).select("id", "source", "target", F.lit(step).alias("m"), m(F.col("c")).alias("x1"), m(F.col("r")).alias("y1"), m(F.col("c") + F.col("dc")).alias("x2"), m(F.col("r") + F.col("dr")).alias("y2"))


def grid_edges_thinned(spark: SparkSession) -> DataFrame:
    """Grid edges without every third: several components and dangling edges."""
    return grid_edges(spark).filter("id % 3 <> 0")


def flow_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points of each flow on the grid's extent: origins, then destinations (id = 2n - 1 and 2n)."""
    f = flows(spark, sf_dir)
    on = lambda c: F.pmod(F.col(c) * 3 + 9500, F.lit(19001)).cast("double")
    o = f.select("flow_id", (F.col("flow_id") * 2 - 1).alias("id"), F.lit("origin").alias("type"), on("ox").alias("x"), on("oy").alias("y"))
    return o.unionByName(f.select("flow_id", (F.col("flow_id") * 2).alias("id"), F.lit("dest").alias("type"), on("dx").alias("x"), on("dy").alias("y")))


#: Columns of the street network, whose rows grow with the table it comes from.
WIDTH = 50


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets (id, source, target, m, x1, y1, x2, y2, line), one for about every other event: event 2n leads from node n to the next column, event 2n + 1 to the next row; users take some away.

    Lengths are whole numbers, so that sums of them are equal in whatever order. Lines have one bend.
    """
    e, u = F.col("event_id"), F.col("user_id")
    node = F.floor(e / 2).cast("long")
    rows = table(spark, sf_dir, "events").select(e.alias("id"), u.alias("user_id"), (node + 1).alias("source"), F.when(e % 2 == 0, node + 2).otherwise(node + 1 + WIDTH).alias("target"), (node % WIDTH).alias("c"), F.floor(node / WIDTH).alias("r"))
    rows = rows.filter((u % 4 != 0) & ((e % 2 == 1) | (F.col("c") < WIDTH - 1)))
    at = lambda c, d: ((F.col(c) + d) * STEP).cast("double")
    x1, y1, x2, y2 = at("c", 0), at("r", 0), at("c", (F.col("id") + 1) % 2), at("r", F.col("id") % 2)
    bend = F.struct(((x1 + x2) / 2 + (u * 37 % 401 - 200)).alias("x"), ((y1 + y2) / 2 + (u * 53 % 401 - 200)).alias("y"))
    line = F.array(F.struct(x1.alias("x"), y1.alias("y")), bend, F.struct(x2.alias("x"), y2.alias("y")))
    return rows.select("id", "source", "target", (200 + u * 7 % 800).cast("int").alias("m"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), line.alias("line"))


def street_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, source, target): every 23rd street, by blocks of ten columns and rows."""
    n = F.col("source") - 1
    block = F.floor(F.floor(n / WIDTH) / 10) * (WIDTH // 10) + F.floor(n % WIDTH / 10) + 1
    return streets(spark, sf_dir).filter("id % 23 = 0").select(block.cast("long").alias("cluster"), "source", "target")
