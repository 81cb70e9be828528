"""Points in polygons, hulls, overlaps and pairs of clusters."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, overlay
from ..plans.storage import materialize, parallelism
from . import grid

HULL = "array<struct<x:double,y:double>>"


def od_points(trips: DataFrame, key: str) -> DataFrame:
    """Two rows for each flow: id 2n - 1 (origin) and 2n (dest)."""
    ends = F.array(F.struct(F.lit("origin").alias("type"), (F.col(key) * 2 - 1).alias("id"), F.col("ox").alias("x"), F.col("oy").alias("y")), F.struct(F.lit("dest").alias("type"), (F.col(key) * 2).alias("id"), F.col("dx").alias("x"), F.col("dy").alias("y")))
    return trips.select(key, F.explode(ends).alias("p")).select("p.id", key, "p.type", "p.x", "p.y")


def within(trips: DataFrame, ring: list[geo.Point], both: bool, boundary: bool = True) -> DataFrame:
    """J9 (both ends in a convex ring), J10 (either end)."""
    o, d = (geo.inside_convex(F.col(a), F.col(b), ring, boundary) for a, b in (("ox", "oy"), ("dx", "dy")))
    return trips.filter(o & d if both else o | d)


def minute_of_day(trips: DataFrame, ts: str) -> DataFrame:
    """Q2: trips with their minute of the day scaled to [0, 1]."""
    from .distance import rescaled

    return rescaled(trips.withColumn("scaled_minute", (F.hour(ts) * 60 + F.minute(ts)).cast("double")), ["scaled_minute"])


def hulls(points: DataFrame, cluster: str, batch: int = 4096) -> DataFrame:
    """(cluster, hull, area, cx, cy, n_points) of clusters whose hull has an area.

    Hulls of parts of about `batch` points are made first, so that a large cluster doesn't meet in one task; what
    the parts leave is few points.
    """
    p = points.select(F.col(cluster).cast("long").alias("cluster"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("cluster IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").distinct()

    def ring(pdf: pd.DataFrame) -> pd.DataFrame:
        h = geo.convex_hull(list(zip(pdf["x"], pdf["y"], strict=True)))
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[0], "x": [a for a, _ in h], "y": [b for _, b in h], "n": [int(pdf["n"].sum())] + [0] * (len(h) - 1)})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        h = geo.convex_hull(list(zip(pdf["x"], pdf["y"], strict=True)))
        a = geo.area(h)
        if a <= 0:
            return pd.DataFrame(columns=["cluster", "hull", "area", "cx", "cy", "n_points"])
        cx, cy = geo.centroid(h)
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]], "hull": [[{"x": x, "y": y} for x, y in h]], "area": [a], "cx": [cx], "cy": [cy], "n_points": [int(pdf["n"].sum())]})

    parts = p.groupBy("cluster").agg(F.ceil(F.count("*") / batch).alias("_n"))
    part = p.join(parts, "cluster").select("cluster", "x", "y", F.lit(1).cast("long").alias("n"), F.pmod(F.xxhash64("x", "y"), F.col("_n")).alias("_p"))
    rings = part.groupBy("cluster", "_p").applyInPandas(ring, "cluster long, x double, y double, n long")
    return rings.groupBy("cluster").applyInPandas(whole, f"cluster long, hull {HULL}, area double, cx double, cy double, n_points long")


def hull_overlaps(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(i, j, shared, jaccard_distance, mean_overlap) of hulls whose extents meet; with one table i < j.

    Hulls meet in grid cells of their own sizes, so no two are compared that are far apart; pairs that aren't listed share nothing.
    """
    take = lambda df, s: df.select(F.col("cluster").alias(s), F.col("hull").alias(f"h{s}"), F.col("area").alias(f"a{s}"))
    pairs = grid.meeting(take(a, "i"), geo.extent(F.col("hi")), take(a if b is None else b, "j"), geo.extent(F.col("hj")))
    if b is None:
        pairs = pairs.filter("i < j")

    @F.pandas_udf("double")
    def shared(hi: pd.Series, hj: pd.Series) -> pd.Series:
        ring = lambda h: [(p["x"], p["y"]) for p in h]
        return pd.Series([geo.convex_overlap(ring(x), ring(y)) for x, y in zip(hi, hj, strict=True)], dtype="float64")

    union = F.col("ai") + F.col("aj") - F.col("shared")
    return pairs.withColumn("shared", shared("hi", "hj")).select("i", "j", "shared", (1 - F.col("shared") / F.nullif(union, F.lit(0.0))).alias("jaccard_distance"), ((F.col("shared") / F.col("ai") + F.col("shared") / F.col("aj")) / 2).alias("mean_overlap"))


RINGS = "array<array<struct<x:double,y:double>>>"
#: Pairs of sides whose crossings are found at once.
OVERLAID = 500_000


def polygon_overlaps(a: DataFrame, b: DataFrame | None = None, with_rings: bool = False) -> DataFrame:
    """(i, j, shared, joined, jaccard_distance) of polygons(polygon, rings) whose extents meet: areas of intersection and union; with one table i < j.

    Polygons are rings with notches, the outer one first, then holes. with_rings: the rings of both, holes after
    outer ones. Null polygons and those without an area share nothing with others.
    """
    if not with_rings:
        return _overlap_areas(a, b)
    take = lambda df, s: df.select(F.col("polygon").alias(s), F.col("rings").alias(f"r{s}")).filter(F.size(f"r{s}") > 0)
    pairs = grid.meeting(take(a, "i"), geo.extent(F.get("ri", F.lit(0))), take(a if b is None else b, "j"), geo.extent(F.get("rj", F.lit(0))))
    if b is None:
        pairs = pairs.filter("i < j")

    @F.pandas_udf(f"shared double, joined double, shared_rings {RINGS}, joined_rings {RINGS}")
    def both(ri: pd.Series, rj: pd.Series) -> pd.DataFrame:
        plain = lambda rings: [[(p["x"], p["y"]) for p in r] for r in rings]
        shape = lambda pieces: [[{"x": x, "y": y} for x, y in r] for r in overlay.rings_of(pieces)]
        found = [overlay.overlay(plain(x), plain(y)) for x, y in zip(ri, rj, strict=True)]
        out = pd.DataFrame({"shared": [overlay.area_of(x) for x, _ in found], "joined": [overlay.area_of(y) for _, y in found]}, dtype="float64")
        return out.assign(shared_rings=[shape(x) for x, _ in found], joined_rings=[shape(y) for _, y in found])

    pairs = pairs.repartition(parallelism(a.sparkSession))  # few bytes a pair, but much work
    out = pairs.select("i", "j", both("ri", "rj").alias("o")).select("i", "j", "o.*")
    return out.withColumn("jaccard_distance", 1 - F.col("shared") / F.nullif("joined", F.lit(0.0)))


def _overlap_areas(a: DataFrame, b: DataFrame | None) -> DataFrame:
    """polygon_overlaps() without rings: the sides of each polygon are made once, and pairs of polygons of as many sides are overlaid together."""

    @F.pandas_udf("array<double>")
    def sides(rings: pd.Series) -> pd.Series:
        return pd.Series([overlay.sides([[(p["x"], p["y"]) for p in r] for r in x]).ravel() for x in rings], dtype=object)

    @F.pandas_udf("shared double, joined double")
    def both(si: pd.Series, sj: pd.Series) -> pd.DataFrame:
        n, m, out = si.map(len).to_numpy(), sj.map(len).to_numpy(), np.zeros((len(si), 2))
        for k, l in np.unique(np.column_stack([n, m]), axis=0).tolist():
            at = np.flatnonzero((n == k) & (m == l))
            step = max(1, OVERLAID // max(1, k * l // 16))
            for own in (at[i : i + step] for i in range(0, len(at), step)):
                p, q = (np.concatenate(s.iloc[own].tolist()).reshape(len(own), w // 4, 4) for s, w in ((si, k), (sj, l)))
                out[own] = np.column_stack(overlay.overlay_areas(p, q))
        return pd.DataFrame(out, columns=["shared", "joined"])

    def take(df: DataFrame, s: str) -> DataFrame:
        own = df.filter(F.size("rings") > 0).select("polygon", sides("rings").alias("s"), geo.extent(F.get("rings", F.lit(0))).alias("e"))
        return own.select(F.col("polygon").alias(s), F.col("s").alias(f"s{s}"), F.col("e").alias(f"e{s}"))

    one = materialize(take(a, "i"), "overlay-sides")
    two = one.select(F.col("i").alias("j"), F.col("si").alias("sj"), F.col("ei").alias("ej")) if b is None else materialize(take(b, "j"), "overlay-sides")
    pairs = grid.meeting(one, F.col("ei"), two, F.col("ej"))
    if b is None:
        pairs = pairs.filter("i < j")
    out = pairs.select("i", "j", both("si", "sj").alias("o")).select("i", "j", "o.*")
    return out.withColumn("jaccard_distance", 1 - F.col("shared") / F.nullif("joined", F.lit(0.0)))


def in_polygons(points: DataFrame, polygons: DataFrame, key: str = "id") -> DataFrame:
    """(key, polygon) of points(key, x, y) inside polygons(polygon, ring): simple rings of any size, convex or not, which meet the points in grid cells."""
    met = grid.points_and_extents(points.select(key, "x", "y"), "x", "y", polygons.select("polygon", "ring"), geo.extent(F.col("ring")))
    most = polygons.agg(F.max(F.size("ring"))).first()[0] or 0
    return met.filter(geo.inside_ring(F.col("x"), F.col("y"), F.col("ring"), max(0, most))).select(key, "polygon")


def availability_in_area(snapshots: DataFrame, area: DataFrame, roads: DataFrame) -> DataFrame:
    """Q6: (time_stamp, cluster, count): vehicles inside an area, counted by the cluster of their nearest road.

    snapshots(time_stamp, x, y); area(polygon, ring); roads(id, cluster, x1, y1, x2, y2).
    """
    from .network import snap

    p = materialize(snapshots.select("time_stamp", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("id", F.monotonically_increasing_id()), "availability-points")
    kept = p.join(in_polygons(p, area).select("id").distinct(), "id", "left_semi")
    ends = roads.withColumns({"source": F.lit(0), "target": F.lit(0)})
    near = snap(kept, ends).select("id", "edge_id").join(roads.select(F.col("id").alias("edge_id"), "cluster"), "edge_id")
    return kept.select("id", "time_stamp").join(near, "id").groupBy("time_stamp", "cluster").agg(F.count("*").alias("count"))


def central_lines(trips: DataFrame, cluster: str) -> DataFrame:
    """(cluster, ox, oy, dx, dy, angle): the line between the means of the distinct origins and destinations."""
    mean = lambda x, y, a, b: trips.select(cluster, x, y).distinct().groupBy(cluster).agg(F.avg(x).alias(a), F.avg(y).alias(b))
    both = mean("ox", "oy", "mox", "moy").join(mean("dx", "dy", "mdx", "mdy"), cluster)
    c = F.col
    return both.select(cluster, c("mox").alias("ox"), c("moy").alias("oy"), c("mdx").alias("dx"), c("mdy").alias("dy"), geo.flow_angle(c("mox"), c("moy"), c("mdx"), c("mdy")).alias("angle"))


def matching_clusters(hulls_a: DataFrame, hulls_b: DataFrame, lines_a: DataFrame, lines_b: DataFrame, reach: float = 500.0, top: int = 3) -> DataFrame:
    """(i, j, rank, score): of clusters of b whose centroid is within reach of one of a, the best `top` by overlap plus likeness of direction."""
    a = hulls_a.select(F.col("cluster").alias("i"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    b = hulls_b.select(F.col("cluster").alias("i"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    cells = [F.floor(F.col(c) / reach).cast("long") for c in ("x", "y")]
    around = a.select(F.col("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), F.explode(F.sequence(cells[0] - 1, cells[0] + 1)).alias("u"), cells[1].alias("_v")).withColumn("v", F.explode(F.sequence(F.col("_v") - 1, F.col("_v") + 1)))
    near = around.join(b.select(F.col("i").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), cells[0].alias("u"), cells[1].alias("v")), ["u", "v"])
    near = near.filter(geo.distance(F.col("xi"), F.col("yi"), F.col("xj"), F.col("yj")) <= reach).select("i", "j")
    # Only hulls that are near another are overlaid.
    own = lambda h, c: h.join(near.select(F.col(c).alias("cluster")).distinct(), "cluster", "left_semi")
    shared = hull_overlaps(own(hulls_a, "i"), own(hulls_b, "j")).select("i", "j", "mean_overlap")
    both = near.join(shared, ["i", "j"], "left").withColumn("mean_overlap", F.coalesce("mean_overlap", F.lit(0.0)))
    both = both.join(lines_a.select(F.col("cluster").cast("long").alias("i"), F.col("angle").alias("p")), "i").join(lines_b.select(F.col("cluster").cast("long").alias("j"), F.col("angle").alias("q")), "j")
    scored = both.withColumn("score", F.col("mean_overlap") + geo.line_angle_similarity(F.col("p"), F.col("q")))
    w = Window.partitionBy("i").orderBy(F.desc("score"), "j")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("i", "j", "rank", "score")


def matching_table(matches: DataFrame, sizes_a: DataFrame, sizes_b: DataFrame) -> DataFrame:
    """A row for each cluster of a: top_1_id to top_3_id, the best score, and how many flows it (count1) and its best match (count2) have; sizes(cluster, n)."""
    tops = matches.groupBy("i").agg(*[F.max(F.when(F.col("rank") == r, F.col("j"))).alias(f"top_{r}_id") for r in (1, 2, 3)], F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"))
    one = sizes_a.select(F.col("cluster").cast("long").alias("i"), F.col("n").alias("count1")).join(tops, "i", "left")
    return one.join(sizes_b.select(F.col("cluster").cast("long").alias("top_1_id"), F.col("n").alias("count2")), "top_1_id", "left").select("i", "top_1_id", "top_2_id", "top_3_id", "score", "count1", "count2")


def od_pair_key(origin: str, dest: str) -> Column:
    """The name of a pair of clusters, the same either way."""
    return F.concat_ws("_", F.least(origin, dest).cast("string"), F.greatest(origin, dest).cast("string"))


def od_pair_ranking(labels: DataFrame, n: int) -> DataFrame:
    """Q3, A3: (pair, n) of the n most frequent pairs of clusters that a flow joins, either way; labels(flow, origin, dest), 0 is noise."""
    return labels.filter("origin <> 0 AND dest <> 0").groupBy(od_pair_key("origin", "dest").alias("pair")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(n)


def flows_of_top_pairs(points: DataFrame, n: int) -> DataFrame:
    """Q3: (flow, pair) of flows whose pair of clusters is among the n most frequent; points(flow, type, cluster) has two rows a flow, which are joined to a pair."""
    side = lambda kind: points.filter(F.col("type") == kind).select("flow", F.col("cluster").alias(kind))
    labels = materialize(side("origin").join(side("dest"), "flow"), "od-labels")
    top = od_pair_ranking(labels, n).select("pair")
    named = labels.filter("origin <> 0 AND dest <> 0").select("flow", od_pair_key("origin", "dest").alias("pair"))
    return named.join(F.broadcast(top), "pair", "left_semi").select("flow", "pair")  # n rows


def lines(origins: DataFrame, dests: DataFrame) -> DataFrame:
    """(id, line) from points of equal id."""
    o = origins.select("id", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("_o"))
    d = dests.select("id", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("_d"))
    return o.join(d, "id").select("id", F.array("_o", "_d").alias("line"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a matching of least total cost (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            less = now < low[free]
            low[free[less]], way[free[less]] = now[less], j0
            j1 = int(free[low[free].argmin()])
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    out[match[1:][match[1:] > 0] - 1] = np.flatnonzero(match[1:] > 0)
    return out


#: Arrangements of a small group that are compared one by one, for many groups at once.
ARRANGED = 120


def _matched(group: pa.Array, id_: np.ndarray, origin: np.ndarray, xy: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """The matchings of whole groups whose rows begin at `starts`, origins before destinations, each by id. Groups of one size that have few arrangements are matched together."""
    ends = np.append(starts[1:], len(id_))
    n = np.add.reduceat(origin.astype(int), starts)
    m, out = ends - starts - n, []
    for a, b in np.unique(np.column_stack([n, m]), axis=0).tolist():
        if a == 0:
            continue
        at = starts[(n == a) & (m == b)][:, None]
        o, d = at + np.arange(a), at + a + np.arange(b)
        step = len(at) if a <= b and math.perm(b, a) <= ARRANGED else 1
        for lo in range(0, len(at), step):
            p, q = o[lo : lo + step], d[lo : lo + step]
            gap = xy[p][:, :, None, :] - xy[q][:, None, :, :]
            cost = np.hypot(gap[..., 0], gap[..., 1])
            if len(at) == step and math.perm(b, a) <= ARRANGED:
                ways = np.array(list(itertools.permutations(range(b), a)))
                best = ways[cost[:, np.arange(a), ways].sum(axis=2).argmin(axis=1)]
            else:
                best = assignment(cost[0])[None, :]
            out.append((p.ravel(), np.take_along_axis(q, best, axis=1).ravel()))
    p, q = (np.concatenate([x[i] for x in out]) if out else np.zeros(0, int) for i in (0, 1))
    return pa.RecordBatch.from_arrays([group.take(pa.array(p)), pa.array(id_[p], pa.int64()), pa.array(id_[q], pa.int64())], names=["group", "origin", "dest"])


def matched_ends(points: DataFrame, group: str) -> DataFrame:
    """(group, origin, dest) of least total distance within each group; points(group, id, type, x, y), as many origins as destinations or fewer.

    Rows come sorted by group, so that the groups of a batch are matched at once; a group is one task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            key = pa.concat_arrays(t.column(0).chunks)
            null = key.is_null().to_numpy(zero_copy_only=False)
            plain = key.fill_null(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, (plain[1:] != plain[:-1]) | (null[1:] != null[:-1])))
            end = len(plain) if last else int(starts[-1])
            held[:] = [] if last else t.slice(end).to_batches()
            if end:
                id_, origin, x, y = (t.column(i).to_numpy()[:end] for i in range(1, 5))
                yield _matched(key.slice(0, end), id_, origin.astype(bool), np.column_stack([x, y]), starts[starts < end])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            if b.column(0)[len(b) - 1] != held[0].column(0)[0]:
                yield from whole(last=False)
        if held:
            yield from whole(last=True)

    kept = points.filter(F.col("type").isin("origin", "dest"))
    rows = kept.select(F.col(group).cast("long").alias("group"), F.col("id").cast("long").alias("id"), (F.col("type") == "origin").alias("first"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    dealt = rows.repartition(parallelism(points.sparkSession, 4), "group").sortWithinPartitions("group", F.desc("first"), "id")
    return dealt.mapInArrow(run, "group long, origin long, dest long").withColumnRenamed("group", group)
