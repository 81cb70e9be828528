"""Road networks, node distances and distances along the network."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import closest, distance, end_point, fraction_on, line_length, rounded, start_point
from ..plans.skew import attach, grouped_prefix, ordered_index
from ..plans.storage import forget, materialize
from . import grid, linear
from .components import CHUNK, connected_components

#: Edges up to which the adjacency is broadcast for searches; beyond it distances are relaxed by joins.
BROADCAST_EDGES = 500_000
#: Ids of edges that a chunk of a running sum spans.
PREFIX_CHUNK = 65_536
#: Rows of searches that are given back at a time.
SEARCHED = 1_000_000
#: Points of an edge in one part.
HOT = 2_048


def components(edges: DataFrame) -> DataFrame:
    """(component, n_nodes)."""
    return connected_components(edges, "source", "target", small=CHUNK).groupBy("component").agg(F.count("*").alias("n_nodes"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the component of most nodes; of equal ones, that with the smallest node."""
    nodes = materialize(connected_components(edges, "source", "target", small=CHUNK), "network-nodes")
    top = nodes.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return edges.join(nodes.join(top, "component").select(F.col("node").alias("source")), "source", "left_semi").select(*edges.columns)


def _adjacent(edges: DataFrame, weight: str) -> DataFrame:
    """(u, v, w) both ways, the shortest of parallel edges."""
    e = edges.select(F.col("source").alias("u"), F.col("target").alias("v"), F.col(weight).cast("double").alias("w"))
    return e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("u", "v").agg(F.min("w").alias("w"))


def node_distances(edges: DataFrame, cutoff: float, weight: str = "m", broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """(source, target, m): rounded length of the shortest path of at most `cutoff`, each node itself at 0 included, both ways."""
    near = materialize(_adjacent(edges, weight), "network-adjacent")
    if near.count() <= 2 * broadcast_edges:
        return _by_search(near, cutoff)
    return _by_relaxing(near, cutoff)


def _sent(near: DataFrame):  # noqa: ANN202
    """The adjacency (as many rows as the caller checked) as three sorted arrays, broadcast: 24 bytes an edge and way."""
    rows = near.select("u", "v", "w").toArrow()
    u, v, w = (rows.column(c).to_numpy() for c in ("u", "v", "w"))
    order = np.lexsort((v, u))
    return near.sparkSession.sparkContext.broadcast((u[order], v[order], w[order]))


def _graph(arrays: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[int, list[tuple[int, float]]]:
    """Node -> its neighbours and their distances, made where a task searches."""
    u, v, w = arrays
    nodes, start = np.unique(u, return_index=True)
    near = list(zip(v.tolist(), w.tolist(), strict=True))
    ends = [*start[1:].tolist(), len(near)]
    return {n: near[a:b] for n, a, b in zip(nodes.tolist(), start.tolist(), ends, strict=True)}


def _within(graph: dict[int, list[tuple[int, float]]], start: int, cutoff: float) -> dict[int, float]:
    """Node -> length of the shortest path from start, of those within the cutoff."""
    best, heap, done = {start: 0.0}, [(0.0, start)], {}
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done[u] = d
        for v, w in graph.get(u, ()):
            if d + w <= cutoff and d + w < best.get(v, float("inf")):
                best[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return done


def _by_search(near: DataFrame, cutoff: float) -> DataFrame:
    sent = _sent(near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, held, size = _graph(sent.value), [], 0
        for pdf in batches:
            for s in pdf["u"].tolist():
                found = _within(graph, s, cutoff)
                held.append((s, found))
                size += len(found)
                if size >= SEARCHED:
                    yield _frame(held)
                    held, size = [], 0
        if held:
            yield _frame(held)

    return near.select("u").distinct().mapInPandas(run, "source long, target long, m int")


def _frame(held: list[tuple[int, dict[int, float]]]) -> pd.DataFrame:
    """Searches as rows; lengths are rounded half-even."""
    source = np.repeat([s for s, _ in held], [len(f) for _, f in held])
    target = np.fromiter((t for _, f in held for t in f), np.int64, len(source))
    m = np.fromiter((d for _, f in held for d in f.values()), float, len(source))
    return pd.DataFrame({"source": source, "target": target, "m": np.rint(m).astype("int32")})


def _by_relaxing(near: DataFrame, cutoff: float) -> DataFrame:
    """Shortest paths by joins: each round extends the paths that the last one improved."""
    known = materialize(near.select(F.col("u").alias("source"), F.col("u").alias("target")).distinct().withColumn("d", F.lit(0.0)), "network-paths")
    front = known
    while True:
        step = front.join(near, F.col("target") == F.col("u")).select("source", F.col("v").alias("target"), (F.col("d") + F.col("w")).alias("d")).filter(F.col("d") <= cutoff)
        step = step.groupBy("source", "target").agg(F.min("d").alias("d"))
        old = known.withColumnRenamed("d", "old")
        better = materialize(step.join(old, ["source", "target"], "left").filter("old IS NULL OR d < old").select("source", "target", "d"), "network-better")
        if better.isEmpty():
            break
        after = materialize(known.unionByName(better).groupBy("source", "target").agg(F.min("d").alias("d")), "network-paths")
        forget(known)
        known, front = after, better
    return known.select("source", "target", rounded(F.col("d")).alias("m"))


def dangling_removed(edges: DataFrame) -> DataFrame:
    """Edges without those that touch a node of degree 1, in one pass."""
    out_n = edges.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("a"))
    in_n = edges.groupBy(F.col("target").alias("n2")).agg(F.count("*").alias("b"))
    degree = out_n.join(in_n, F.col("node") == F.col("n2"), "full").select(F.coalesce("node", "n2").alias("node"), (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("degree"))
    s = degree.select(F.col("node").alias("source"), F.col("degree").alias("_s"))
    t = degree.select(F.col("node").alias("target"), F.col("degree").alias("_t"))
    return edges.join(s, "source").join(t, "target").filter("_s > 1 AND _t > 1").select(*edges.columns)


def shortest_paths(edges: DataFrame, wanted: DataFrame, weight: str = "m", broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """(start, stop, m, nodes) for wanted(start, stop); of equal paths that through the smaller last nodes. No row where there is none."""
    near = _adjacent(edges, weight)
    if near.count() > 2 * broadcast_edges:
        raise ValueError("the network is too large to search whole; cut it down by components or extent first")
    sent = _sent(near)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = _graph(sent.value)
        for pdf in batches:
            rows = [(a, b, *p) for a, b in zip(pdf["start"].tolist(), pdf["stop"].tolist(), strict=True) if (p := path_between(graph, a, b))]
            yield pd.DataFrame(rows, columns=["start", "stop", "m", "nodes"])

    return wanted.select("start", "stop").mapInPandas(run, "start long, stop long, m double, nodes array<long>")


def path_between(graph: dict[int, list[tuple[int, float]]], a: int, b: int) -> tuple[float, list[int]] | None:
    best, before, heap, done = {a: 0.0}, {}, [(0.0, a)], set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        done.add(u)
        if u == b:
            out = [b]
            while out[-1] != a:
                out.append(before[out[-1]])
            return d, out[::-1]
        for v, w in graph.get(u, ()):
            if d + w < best.get(v, float("inf")) or (d + w == best.get(v) and u < before.get(v, u)):
                best[v], before[v] = d + w, u
                heapq.heappush(heap, (d + w, v))
    return None


def outer_points(networks: DataFrame, points: DataFrame) -> DataFrame:
    """For each cluster and end (node of degree 1) of its network, the points on the edge there that are nearest to it (W7: ties stay).

    networks(cluster, id, source, target), points(cluster, point, edge, to_source, to_target).
    """
    ends = networks.select("cluster", "id", F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(True).alias("at_source")), F.struct(F.col("target").alias("node"), F.lit(False).alias("at_source")))).alias("e")).select("cluster", "id", "e.*")
    w = Window.partitionBy("cluster", "node")
    free = ends.withColumn("n", F.count("*").over(w)).filter("n = 1")
    on = free.join(points, (points["edge"] == free["id"]) & (points["cluster"] == free["cluster"])).drop(points["cluster"])
    on = on.withColumn("d", F.when(F.col("at_source"), F.col("to_source")).otherwise(F.col("to_target")))
    return on.withColumn("least", F.min("d").over(w)).filter("d = least").select("cluster", "node", "point", F.col("d").alias("distance"))


def trimmed(networks: DataFrame, outer: DataFrame) -> DataFrame:
    """The networks with their free ends cut off at the outer points: (cluster, id, from_m, to_m) of each edge's part that stays.

    networks(cluster, id, source, target, m). An end without a point keeps its edge whole; where one point is the outer
    point of both ends, a part of no length would be left, and one of 1e-4 stays.
    """
    o = outer.groupBy("cluster", "node").agg(F.min("distance").alias("cut"))
    s = o.select("cluster", F.col("node").alias("source"), F.col("cut").alias("a"))
    t = o.select("cluster", F.col("node").alias("target"), F.col("cut").alias("b"))
    rows = networks.join(s, ["cluster", "source"], "left").join(t, ["cluster", "target"], "left")
    a, b = F.coalesce("a", F.lit(0.0)), F.col("m") - F.coalesce("b", F.lit(0.0))
    return rows.select("cluster", "id", a.alias("from_m"), F.greatest(b, a + 1e-4).alias("to_m"))


def snap(points: DataFrame, edges: DataFrame, radius: float = 500.0, extent: float = 1e7) -> DataFrame:
    """points(id, x, y) with edge_id, cx, cy, dist, dist_to_start, dist_to_end of their nearest edge (of equal ones the smaller id, of its places the first).

    Edges have a line of any number of points, or two ends. Points and segments meet in grid cells of the segments' own
    sizes; points without an edge within the radius are tried again with a radius eight times as large, until
    `extent`. So each point compares the segments near it, an edge of any length has few rows, and the result is exact.
    """
    seg = linear.segments(edges)
    seg = materialize(seg, "snap-segments") if "line" in edges.columns else seg
    left, out = points.select("id", "x", "y").filter("x IS NOT NULL AND y IS NOT NULL"), None
    c = F.col
    while radius <= extent:
        around = grid.box(F.least("x1", "x2") - radius, F.least("y1", "y2") - radius, F.greatest("x1", "x2") + radius, F.greatest("y1", "y2") + radius)
        cx, cy = closest(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2"))
        near = grid.points_and_extents(left, "x", "y", seg, around).withColumn("cx", cx).withColumn("cy", cy).withColumn("dist", distance(c("x"), c("y"), c("cx"), c("cy"))).filter(c("dist") <= radius)
        start, end = c("from_m") + distance(c("cx"), c("cy"), c("x1"), c("y1")), distance(c("cx"), c("cy"), c("x2"), c("y2")) + (c("total") - c("to_m"))
        near = near.withColumn("dist_to_start", rounded(start)).withColumn("dist_to_end", rounded(end))
        best = near.groupBy("id", "x", "y").agg(F.min(F.struct("dist", "edge_id", "seq", "cx", "cy", "dist_to_start", "dist_to_end")).alias("b"))
        best = materialize(best.select("id", "x", "y", "b.dist", "b.edge_id", "b.cx", "b.cy", "b.dist_to_start", "b.dist_to_end"), "snap")
        out = best if out is None else out.unionByName(best)
        left = left.join(best.select("id"), "id", "left_anti")
        if left.isEmpty():
            break
        left = materialize(left, "snap-left")
        radius *= 8
    return out


def nearest_within(points: DataFrame, edges: DataFrame, reach: float = 1e-7) -> DataFrame:
    """(id, edge_id) of points within reach of an edge: the nearest, of equal ones the smaller id. Points without one go."""
    near = snap(points, edges, radius=max(reach, 1.0), extent=max(reach, 1.0))
    return near.filter(F.col("dist") <= reach).select("id", "edge_id")


def collapsed_edges(lines: DataFrame) -> DataFrame:
    """(id, source, target, m) of lines(id, line) of any number of points. Nodes are the places where lines end, numbered from 1 in the order of (x, y); m is the line's length."""
    ends = lines.select("id", start_point(F.col("line")).alias("a"), end_point(F.col("line")).alias("b"), line_length(F.col("line")).alias("m")).filter("a IS NOT NULL")
    places = ordered_index(ends.select(F.explode(F.array("a", "b")).alias("p")).distinct(), [F.col("p.x"), F.col("p.y")], "_i", "collapsed-nodes").select("p", (F.col("_i") + 1).alias("node"))
    out = ends.join(places.select(F.col("p").alias("a"), F.col("node").alias("source")), "a").join(places.select(F.col("p").alias("b"), F.col("node").alias("target")), "b")
    return out.select("id", "source", "target", "m")


def with_nodes(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Snapped points as (id, edge, s, e, src, tgt): distances to the edge's ends, and its nodes. Points on unknown edges go."""
    e = edges.select(F.col("id").alias("edge"), F.col("source").alias("src"), F.col("target").alias("tgt"))
    return points.select("id", F.col("edge_id").alias("edge"), F.col("dist_to_start").cast("int").alias("s"), F.col("dist_to_end").cast("int").alias("e")).join(e, "edge")


def edge_ways(used: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_i, edge_j, ss, tt, st, ts) of used(edge, src, tgt): distances between the ends of two edges of which all four are in nodes(source, target, m); an edge and itself need none."""
    a, b = (used.select(*[F.col(c).alias(f"{c}_{s}") for c in ("edge", "src", "tgt")]) for s in ("i", "j"))
    hop = lambda u, v, name: nodes.select(F.col("source").alias(u), F.col("target").alias(v), F.col("m").alias(name))
    far = a.join(hop("src_i", "src_j", "ss"), "src_i").join(b, "src_j").filter("edge_i <> edge_j")
    for u, v, name in (("tgt_i", "tgt_j", "tt"), ("src_i", "tgt_j", "st"), ("tgt_i", "src_j", "ts")):
        far = far.join(hop(u, v, name), [u, v])
    ways = ("ss", "tt", "st", "ts")
    kind = dict(nodes.dtypes)["m"]
    same = used.select(F.col("edge").alias("edge_i"), F.col("edge").alias("edge_j"), *[F.lit(None).cast(kind).alias(w) for w in ways])
    return far.select("edge_i", "edge_j", *ways).unionByName(same)


def _crowds(points: DataFrame) -> DataFrame:
    """(edge, src, tgt, n, parts) of the edges that hold points: those of more than HOT points have several parts."""
    own = points.groupBy("edge").agg(F.min("src").alias("src"), F.min("tgt").alias("tgt"), F.count("*").alias("n"))
    return materialize(own.withColumn("parts", F.ceil(F.col("n") / HOT).cast("int")), "point-edges")


def _dealt(points: DataFrame, crowds: DataFrame) -> DataFrame:
    """points with `part`: those of a crowded edge are dealt into parts, so that no two groups that meet make more than HOT * HOT pairs."""
    if crowds.filter("parts > 1").isEmpty():
        return points.withColumn("part", F.lit(0))
    counts = crowds.select("edge", "n", "parts")
    return materialize(attach(points, counts, "edge", "n", F.xxhash64("id")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "point-parts")


def point_distances(points: DataFrame, nodes: DataFrame, other: DataFrame | None = None, squared: bool = False) -> DataFrame:
    """(i, j, d) along the network, from with_nodes() points and node distances.

    On one edge the difference of their distances to its start; else the shortest of the four ways by their
    edges' ends. Pairs for which one of the four node distances is missing go. With one table i < j; with
    `other` all of points against all of other, save equal ids. squared: squares of these.
    The four distances are found once for each two edges, and points meet by their edges, those of crowded edges in parts.
    """
    fields = ("id", "edge", "s", "e", "src", "tgt")
    held_a = _crowds(points)
    a, held_b = _dealt(points.select(*fields), held_a), held_a if other is None else _crowds(other)
    b = a if other is None else _dealt(other.select(*fields), held_b)
    used = held_a.select("edge", "src", "tgt") if other is None else held_a.select("edge", "src", "tgt").unionByName(held_b.select("edge", "src", "tgt")).distinct()
    held = lambda t, s: t.select(F.col("edge").alias(f"edge_{s}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{s}"))
    ways = edge_ways(used, nodes).join(held(held_a, "i"), "edge_i").join(held(held_b, "j"), "edge_j")
    side = lambda t, s: t.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "edge", "part", "s", "e")])
    met = side(a, "i").join(ways, ["edge_i", "part_i"]).join(side(b, "j"), ["edge_j", "part_j"])
    met = met.filter(F.col("id_i") < F.col("id_j") if other is None else F.col("id_i") != F.col("id_j"))
    c = F.col
    over = F.least(c("s_i") + c("s_j") + c("ss"), c("e_i") + c("e_j") + c("tt"), c("s_i") + c("e_j") + c("st"), c("e_i") + c("s_j") + c("ts"))
    out = met.select(c("id_i").alias("i"), c("id_j").alias("j"), F.when(c("ss").isNull(), F.abs(c("s_j") - c("s_i"))).otherwise(over).alias("d"))
    return out.withColumn("d", F.col("d").cast("long") * F.col("d")) if squared else out


def flow_distances(origins: DataFrame, dests: DataFrame, nodes: DataFrame, squared: bool = False, missing_as_zero: DataFrame | None = None) -> DataFrame:
    """(i, j, d): distance of origins plus that of destinations, for pairs that have both.

    Ids of both are flow ids. D13: with missing_as_zero(i, j), a row for each of its pairs, where a missing part counts 0.
    """
    o, d = point_distances(origins, nodes, squared=squared), point_distances(dests, nodes, squared=squared).withColumnRenamed("d", "d2")
    if missing_as_zero is None:
        return o.join(d, ["i", "j"]).select("i", "j", (F.col("d") + F.col("d2")).alias("d"))
    zero = F.lit(0)
    return missing_as_zero.select("i", "j").join(o, ["i", "j"], "left").join(d, ["i", "j"], "left").select("i", "j", (F.coalesce("d", zero) + F.coalesce("d2", zero)).alias("d"))


def sampled_points(edges: DataFrame, apart: float) -> DataFrame:
    """Points along edges at most `apart` from each other, both ends included: id (by edge and place), edge_id, x, y, dist_to_start, dist_to_end.

    Edges have a line of any number of points, or two ends; places are equally far apart along the line, and each segment makes those that it holds.
    """
    seg = materialize(linear.segments(edges), "sampled-segments")
    e = seg.filter("seq = 0").select("edge_id", F.col("total").alias("_l"), F.greatest(F.lit(1), F.ceil(F.col("total") / apart)).cast("int").alias("_n"))
    # A place's number: what earlier edges of its network hold.
    e = grouped_prefix(e.withColumn("_g", F.lit(0)), ["_g"], F.floor(F.col("edge_id") / PREFIX_CHUNK), [F.col("edge_id")], F.col("_n") + 1, "_s")
    step = F.col("_l") / F.col("_n")
    low = F.when(F.col("_l") > 0, F.greatest(F.lit(0), F.floor(F.col("from_m") / step) - 1)).otherwise(F.lit(0)).cast("int")
    high = F.when(F.col("_l") > 0, F.least(F.col("_n"), F.ceil(F.col("to_m") / step) + 1)).otherwise(F.col("_n")).cast("int")
    p = seg.join(e, "edge_id").withColumn("place", F.explode(F.sequence(low, high))).withColumn("_t", F.col("place") / F.col("_n")).withColumn("_at", F.col("_t") * F.col("_l"))
    last = F.col("to_m") >= F.col("total")
    first_last = last & (F.col("from_m") < F.col("total")) | (F.col("total") == 0) & (F.col("seq") == 0)
    p = p.filter((F.col("_at") >= F.col("from_m")) & ((F.col("_at") < F.col("to_m")) | first_last))
    x, y = linear.at_length(F.col("_at"))
    return p.select((F.col("_s") + F.col("place") + 1).alias("id"), "edge_id", x.alias("x"), y.alias("y"), F.col("_at").alias("dist_to_start"), ((1 - F.col("_t")) * F.col("_l")).alias("dist_to_end"))


def edge_clusters(sampled: DataFrame, clustered: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, cluster): an edge takes the cluster of the clustered point nearest along the network to its sampled points.

    Each end of an edge takes the cluster of its own sampled place's nearest point; the edge takes the common one, else the smaller.
    sampled, clustered: with_nodes() tables, the latter with `cluster`. Ids of the two tables don't relate.
    """
    big = sampled.select((-F.col("id")).alias("id"), "edge", "s", "e", "src", "tgt")
    d = point_distances(big, nodes, clustered.select("id", "edge", "s", "e", "src", "tgt"))
    near = d.groupBy("i").agg(F.min(F.struct("d", "j")).alias("b")).select((-F.col("i")).alias("id"), F.col("b.j").alias("j"))
    lab = near.join(clustered.select(F.col("id").alias("j"), "cluster"), "j").join(sampled.select("id", "edge", "s", "e"), "id")
    ends = lab.groupBy("edge").agg(F.min_by("cluster", F.struct("s", "id")).alias("a"), F.min_by("cluster", F.struct("e", "id")).alias("b"))
    return ends.join(edges.select(F.col("id").alias("edge")), "edge", "left_semi").select(F.col("edge").alias("id"), F.least("a", "b").alias("cluster"))


def blended(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Edges cut at points(edge_id, x, y) that lie on them: (id, part, from_t, to_t, line), parts from 1, fractions of the edge's length, and the part's own points.

    Edges have a line of any number of points, or two ends. A point cuts its edge at the place nearest to it.
    """
    seg, c = materialize(linear.segments(edges), "blended-segments"), F.col
    on = points.select("edge_id", "x", "y").join(seg, "edge_id")
    t = fraction_on(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2"))
    cx, cy = closest(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2"))
    near = on.groupBy("edge_id", "x", "y").agg(F.min(F.struct(distance(c("x"), c("y"), cx, cy).alias("d"), "seq", (c("from_m") + t * (c("to_m") - c("from_m"))).alias("s"), "total")).alias("b"))
    ends = seg.filter("seq = 0").select("edge_id", F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))
    cuts = ends.unionByName(near.select("edge_id", F.when(c("b.total") > 0, c("b.s") / c("b.total")).otherwise(0.0).alias("t"))).distinct()
    w = Window.partitionBy("edge_id").orderBy("t")
    parts = materialize(cuts.withColumn("to_t", F.lead("t").over(w)).withColumn("part", F.row_number().over(w)).filter("to_t IS NOT NULL").withColumnRenamed("t", "from_t"), "blended-parts")
    total = seg.filter("seq = 0").select("edge_id", "total")
    lines = linear.parts_of(seg, parts.join(total, "edge_id").select("edge_id", "part", (c("from_t") * c("total")).alias("from_t"), (c("to_t") * c("total")).alias("to_t")))
    return parts.join(lines, ["edge_id", "part"]).select(c("edge_id").alias("id"), "part", "from_t", "to_t", "line")
