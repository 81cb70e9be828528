"""Cells of all levels, and places along lines, against plain evaluations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from odweave.functions import geo
from odweave.operators import grid, linear, network, spatial


def test_one_huge_extent(spark):
    """100,000 squares of 10 m and one of 1,000 km: nobody has more rows than nine for each level."""
    small = spark.range(100_000).select(F.col("id").alias("polygon"), (F.col("id") * 7919 % 1_000_003).cast("double").alias("x"), (F.col("id") * 6271 % 1_000_003).cast("double").alias("y"), F.lit(10.0).alias("side"))
    all_ = small.unionByName(spark.createDataFrame([(-1, -5.0, -5.0, 1e6), (-2, -3e5, 7.0, 0.0)], "polygon long, x double, y double, side double"))
    own = grid.box(F.col("x"), F.col("y"), F.col("x") + F.col("side"), F.col("y") + F.col("side"))
    used = grid.levels(all_, own)
    most = grid.looking(all_.select("polygon", own.alias("b")), F.col("b"), used).groupBy("polygon").count().agg(F.max("count")).first()[0]
    assert len(used) == 3 and most <= 9 * len(used)
    take = lambda s: all_.select(F.col("polygon").alias(s), own.alias(f"b{s}"))
    met = grid.meeting(take("i"), F.col("bi"), take("j"), F.col("bj"))
    of_huge = met.filter("i = -1 AND j >= 0").count()
    want = all_.filter("polygon >= 0 AND x <= 1e6 - 5 AND y <= 1e6 - 5").count()
    assert of_huge == want and met.filter("j = -1 AND i >= 0").count() == want and met.filter("i = j").count() == 100_002


@pytest.mark.parametrize("scale", [1.0, 1e-4])
def test_meeting_by_definition(spark, scale):
    rnd = random.Random(2)
    boxes = [(i, x := rnd.uniform(-50, 50) * scale, y := rnd.uniform(-50, 50) * scale, x + rnd.choice([0, 1, 3, 40]) * scale, y + rnd.choice([0, 0.5, 8, 60]) * scale) for i in range(150)]
    boxes += [(200, 0.0, 0.0, 16 * scale, 16 * scale), (201, 16 * scale, 16 * scale, 32 * scale, 32 * scale), (202, None, None, None, None)]
    df = spark.createDataFrame(boxes, "k long, a double, b double, c double, d double")
    take = lambda s: df.select(F.col("k").alias(s), grid.box(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias(f"b{s}"))
    got = sorted((r.i, r.j) for r in grid.meeting(take("i"), F.col("bi"), take("j"), F.col("bj")).collect())
    real = [b for b in boxes if b[1] is not None]
    assert got == sorted((p[0], q[0]) for p in real for q in real if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert grid.meeting(take("i").limit(0), F.col("bi"), take("j"), F.col("bj")).count() == 0


LINES = [(1, [(0, 0), (10, 0), (10, 10)]), (2, [(0, 5), (0, 5), (4, 9), (8, 5)]), (3, [(20, 0), (20, 7)]), (4, [(3, 3)]), (5, None), (6, [(30, 30), (30, 30)])]


def _edges(spark):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in line] if line else None, "clash") for i, line in LINES], f"id long, line {linear.LINE}, total string")


def _place(line, s):
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        m = math.dist((ax, ay), (bx, by))
        if s <= m + 1e-12:
            t = s / m if m else 0
            return ax + t * (bx - ax), ay + t * (by - ay)
        s -= m
    return line[-1]


def test_snap_to_bent_lines(spark):
    rnd = random.Random(4)
    pts = [(i, rnd.uniform(-5, 25), rnd.uniform(-5, 15)) for i in range(60)] + [(90, 400.0, 400.0), (91, None, 1.0), (92, 30.0, 31.0)]
    got = {r.id: r for r in network.snap(spark.createDataFrame(pts, "id long, x double, y double"), _edges(spark), radius=2.0).collect()}
    assert 91 not in got and len(got) == 62
    for i, x, y in pts:
        if x is None:
            continue
        best = min((math.dist((x, y), _place(line, s / 500 * sum(math.dist(*p) for p in zip(line, line[1:], strict=False)))), e) for e, line in LINES if line and len(line) > 1 for s in range(501))
        assert got[i].dist <= best[0] + 1e-9 and got[i].dist >= best[0] - 0.02
        line = dict(LINES)[got[i].edge_id]
        whole = sum(math.dist(*p) for p in zip(line, line[1:], strict=False))
        assert abs(got[i].dist_to_start + got[i].dist_to_end - whole) <= 1.01
        assert math.dist(_place(line, got[i].dist_to_start), (got[i].cx, got[i].cy)) <= 0.51


def test_samples_and_cuts(spark):
    found = {}
    for r in network.sampled_points(_edges(spark), 3.0).orderBy("id").collect():
        found.setdefault(r.edge_id, []).append(r)
    assert [r.id for e in sorted(found) for r in found[e]] == list(range(1, sum(map(len, found.values())) + 1))
    for e, line in LINES:
        if line is None or len(line) < 2:
            assert e not in found
            continue
        whole = sum(math.dist(*p) for p in zip(line, line[1:], strict=False))
        n = max(1, math.ceil(whole / 3))
        assert len(found[e]) == n + 1
        for i, r in enumerate(found[e]):
            assert (r.x, r.y) == pytest.approx(_place(line, i * whole / n)) and r.dist_to_start + r.dist_to_end == pytest.approx(whole)
    at = [(1, 4.0, 0.0), (1, 10.0, 0.0), (1, 10.0, 6.0), (2, 4.0, 9.0), (3, 20.0, 0.0), (3, 20.0, 0.0), (99, 1.0, 1.0)]
    cut = {(r.id, r.part): [(p.x, p.y) for p in r.line] for r in network.blended(_edges(spark), spark.createDataFrame(at, "edge_id long, x double, y double")).collect()}
    assert {k: v for k, v in cut.items() if k[0] in (1, 3)} == {(1, 1): [(0, 0), (4, 0)], (1, 2): [(4, 0), (10, 0)], (1, 3): [(10, 0), (10, 6)], (1, 4): [(10, 6), (10, 10)], (3, 1): [(20, 0), (20, 7)]}
    assert sum(cut[2, 1], ()) == pytest.approx((0, 5, 4, 9)) and sum(cut[2, 2], ()) == pytest.approx((4, 9, 8, 5))


def test_points_in_rings(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rings = [(1, ring((0, 0), (10, 0), (10, 10), (5, 5), (0, 10))), (2, ring((-1000, -1000), (1000, -1000), (1000, 1000), (-1000, 1000))), (3, []), (4, None)]
    pts = [(1, 5.0, 8.0), (2, 2.0, 6.0), (3, 5000.0, 0.0), (4, None, 2.0)]
    got = spatial.in_polygons(spark.createDataFrame(pts, "id long, x double, y double"), spark.createDataFrame(rings, f"polygon long, ring {linear.LINE}"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (2, 1), (2, 2)]


def test_crowded_cells_are_dealt_and_nothing_is_broadcast(spark, monkeypatch):
    from odweave.operators import grid

    monkeypatch.setattr(grid, "CROWD", 3)
    boxes = [(i, (i * 37 % 100) * 1.0, (i * 61 % 100) * 1.0, 200.0 if i % 9 == 0 else 2.0 + i % 5) for i in range(60)]
    df = spark.createDataFrame(boxes, "id long, x double, y double, side double")
    take = lambda s: df.select(F.col("id").alias(s), grid.box(F.col("x"), F.col("y"), F.col("x") + F.col("side"), F.col("y") + F.col("side")).alias(f"b{s}"))
    met = grid.meeting(take("i"), F.col("bi"), take("j"), F.col("bj"))
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if a[1] <= b[1] + b[3] and b[1] <= a[1] + a[3] and a[2] <= b[2] + b[3] and b[2] <= a[2] + a[3])
    assert sorted((r.i, r.j) for r in met.collect()) == want and "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    points = df.select("id", F.col("x").alias("px"), F.col("y").alias("py"))
    held = grid.points_and_extents(points, "px", "py", take("j"), F.col("bj"))
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if b[1] <= a[1] <= b[1] + b[3] and b[2] <= a[2] <= b[2] + b[3])
    assert sorted((r.id, r.j) for r in held.collect()) == want and "Broadcast" not in held._jdf.queryExecution().executedPlan().toString()


def test_small_rings_are_written_out(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 3), (0, 10)]
    points = [(i, x * 1.0, y + 0.5) for i, (x, y) in enumerate((x, y) for x in range(-1, 12) for y in range(-1, 11))]
    r = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring])
    got = spark.createDataFrame(points, "i int, x double, y double").select(geo.inside_ring(F.col("x"), F.col("y"), r).alias("a"), geo.inside_ring(F.col("x"), F.col("y"), r, 5).alias("b"), geo.inside_ring(F.col("x"), F.col("y"), r, 9).alias("c")).collect()
    assert all(r.a == r.b == r.c for r in got) and 0 < sum(r.a for r in got) < len(got)
