"""Linear referencing: lines of any number of points as segments with running lengths, and places along them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import distance

LINE = "array<struct<x:double,y:double>>"


def line_of(edges: DataFrame) -> Column:
    """An edge's line: its column `line`, or the straight one from (x1, y1) to (x2, y2)."""
    if "line" in edges.columns:
        return F.transform("line", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    point = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return F.array(point("x1", "y1"), point("x2", "y2"))


def segments(edges: DataFrame) -> DataFrame:
    """(edge_id, seq, x1, y1, x2, y2, from_m, to_m, total): the segments of each edge(id, line or ends), numbered from 0, with the length of the line before and after each.

    Null lines and those of fewer than two points have none. Segments of no length stay.
    """
    if "line" not in edges.columns:  # one segment each
        ends = edges.select(F.col("id").alias("edge_id"), F.lit(0).alias("seq"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
        m = distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
        return ends.withColumns({"to_m": m, "from_m": F.lit(0.0), "total": m})
    own = edges.select(F.col("id").alias("edge_id"), line_of(edges).alias("_line")).filter(F.size("_line") > 1)
    pairs = F.zip_with(F.slice("_line", 1, F.size("_line") - 1), F.slice("_line", 2, F.size("_line") - 1), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    rows = own.select("edge_id", F.posexplode(pairs).alias("seq", "s")).select("edge_id", "seq", "s.*").withColumn("_m", distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    w = Window.partitionBy("edge_id").orderBy("seq")  # the segments of one line
    rows = rows.withColumn("to_m", F.sum("_m").over(w)).withColumn("from_m", F.coalesce(F.lag("to_m").over(w), F.lit(0.0)))
    return rows.withColumn("total", F.max("to_m").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).drop("_m")


def at_length(s: Column) -> tuple[Column, Column]:
    """The place at a length along a line, by the columns of the segment that holds it."""
    m = F.col("to_m") - F.col("from_m")
    t = F.when(m > 0, (s - F.col("from_m")) / m).otherwise(F.lit(0.0))
    return F.col("x1") + t * (F.col("x2") - F.col("x1")), F.col("y1") + t * (F.col("y2") - F.col("y1"))


def parts_of(segs: DataFrame, parts: DataFrame) -> DataFrame:
    """parts(edge_id, part, from_t, to_t), lengths along an edge, with `line`: its points from the one to the other. Parts meet segments by their edge."""
    rows = segs.join(parts.select("edge_id", "part", F.col("from_t").alias("_a"), F.col("to_t").alias("_b")), "edge_id").filter("to_m >= _a AND from_m <= _b")
    place = lambda s: F.struct(s.alias("s"), F.struct(*[c.alias(n) for c, n in zip(at_length(s), "xy", strict=True)]).alias("p"))
    ends = F.array(place(F.greatest("_a", "from_m")), place(F.least("_b", "to_m")))
    all_ = F.array_distinct(F.sort_array(F.flatten(F.collect_list(ends))))
    inner = rows.groupBy("edge_id", "part").agg(all_.alias("_all"))
    # Segments meet at their ends, which both give: of places of one length the first stays.
    return inner.select("edge_id", "part", F.transform(F.filter("_all", lambda x, i: (i == 0) | (x["s"] > F.get(F.col("_all"), i - 1)["s"])), lambda x: x["p"]).alias("line"))
