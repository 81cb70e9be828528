"""Overlay of general polygons against areas by sampling and by definition; geometry as text."""

import math
import random

import pytest
from pyspark.sql import functions as F

from odweave.functions import overlay, text
from odweave.operators import spatial

SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4)]


def _areas(a, b):
    both, either = overlay.overlay(a, b)
    for pieces in (both, either):
        rings = overlay.rings_of(pieces)
        assert sum(overlay._signed(overlay.np.array(r)) for r in rings) == pytest.approx(overlay.area_of(pieces), abs=1e-6)
    return overlay.area_of(both), overlay.area_of(either)


@pytest.mark.parametrize(
    ("a", "b", "shared", "joined"),
    [
        ([SQUARE], [SQUARE], 16, 16),  # all sides in common
        ([SQUARE], [SQUARE[::-1] + SQUARE[-1:]], 16, 16),  # the other way round, and closed
        ([SQUARE], [[(4, 0), (8, 0), (8, 4), (4, 4)]], 0, 32),  # a side in common, against each other
        ([SQUARE], [[(2, 0), (6, 0), (6, 4), (2, 4)]], 8, 24),  # parts of sides in common
        ([SQUARE], [[(4, 4), (6, 4), (6, 6)]], 0, 18),  # a corner in common
        ([SQUARE, [(1, 1), (3, 1), (3, 3), (1, 3)]], [[(1, 1), (3, 1), (3, 3), (1, 3)]], 0, 16),  # fills the hole
        ([SQUARE, [(1, 1), (3, 1), (3, 3), (1, 3)]], [[(2, -1), (5, -1), (5, 5), (2, 5)]], 6, 24),
        ([[(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]], [[(-1, 3), (7, 3), (7, 5), (-1, 5)]], 8, 36),  # two pieces
        ([SQUARE], [[(10, 10), (11, 10), (11, 11)]], 0, 16.5),
        ([SQUARE], [[(1, 1), (2, 1), (2, 2), (1, 2)]], 1, 16),
        ([SQUARE], [[(0, 0), (1, 1)]], 0, 16),
        ([SQUARE], [], 0, 16),
    ],
)
def test_overlay(a, b, shared, joined):
    assert _areas(a, b) == pytest.approx((shared, joined))
    assert _areas(b, a) == pytest.approx((shared, joined))


def test_overlay_by_sampling():
    rnd = random.Random(3)

    def star(n):
        cx, cy = rnd.uniform(-3, 3), rnd.uniform(-3, 3)
        turn = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
        return [(cx + (r := rnd.uniform(1, 6)) * math.cos(t), cy + r * math.sin(t)) for t in turn]

    def inside(ring, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    for _ in range(6):
        a, b = star(9), star(12)
        n = 150
        cells = [((i + 0.5) * 20 / n - 10, (j + 0.5) * 20 / n - 10) for i in range(n) for j in range(n)]
        hits = [(inside(a, x, y), inside(b, x, y)) for x, y in cells]
        got, unit = _areas([a], [b]), 400 / n / n
        assert got[0] == pytest.approx(sum(p and q for p, q in hits) * unit, abs=1.0) and got[1] == pytest.approx(sum(p or q for p, q in hits) * unit, abs=1.5)


def test_polygon_overlaps(spark):
    shape = lambda *rings: [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]
    polygons = [(1, shape(SQUARE, [(1, 1), (3, 1), (3, 3), (1, 3)])), (2, shape([(2, -1), (5, -1), (5, 5), (2, 5)])), (3, None), (4, []), (5, shape([(90, 90), (91, 90), (91, 91)]))]
    df = spark.createDataFrame(polygons, f"polygon long, rings {spatial.RINGS}")
    r = spatial.polygon_overlaps(df, with_rings=True).collect()
    assert len(r) == 1 and (r[0].i, r[0].j) == (1, 2) and (r[0].shared, r[0].joined) == pytest.approx((6, 24)) and r[0].jaccard_distance == pytest.approx(0.75)
    assert len(r[0].shared_rings) == 1 and len(r[0].shared_rings[0]) == 8 and len(r[0].joined_rings) == 2


def test_wkt(spark):
    texts = [
        "POINT (1 -2.5e1)", " point(1 2)", "SRID=25832;POINT (3 4)", "POINT EMPTY", "POINT (1)", "POINT (1 2 3)", "POINT (1 x)", "POINT (1 2", None, "", "LINESTRING (1 2, 3 4,5 6)", "LINESTRING (1 2)", "LINESTRING EMPTY",
        "LINESTRING (1 2, )", "LINESTRING ()", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "POLYGON ((0 0, 4 0, 4 4))", "POLYGON (0 0, 4 0, 4 4, 0 0)", "POLYGON EMPTY", "POLYGON ((0 0, 4 0, 4 4, 0 0), ())", "LINESTRING (1 2, 3 4) x", "LINESTRING (1 2; 3 4)",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.point_from_wkt(F.col("t")).alias("p"), text.line_from_wkt(F.col("t")).alias("l"), text.polygon_from_wkt(F.col("t")).alias("g"))
    got = {r.t: (r.p and (r.p.x, r.p.y), r.l and [(p.x, p.y) for p in r.l] if r.l is not None else None, [[(p.x, p.y) for p in ring] for ring in r.g] if r.g is not None else None) for r in df.collect()}
    want = {
        "POINT (1 -2.5e1)": ((1, -25), None, None), " point(1 2)": ((1, 2), None, None), "SRID=25832;POINT (3 4)": ((3, 4), None, None), "LINESTRING (1 2, 3 4,5 6)": (None, [(1, 2), (3, 4), (5, 6)], None),
        "LINESTRING EMPTY": (None, [], None), "POLYGON EMPTY": (None, None, []), "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))": (None, None, [[(0, 0), (4, 0), (4, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]]),
    }
    assert got == {t: want.get(t, (None, None, None)) for t in texts}


def test_geojson(spark):
    texts = ['{"type":"Point","coordinates":[1,2,9]}', '{"type":"Point","coordinates":[1]}', '{"type":"LineString","coordinates":[[1,2],[3,4.5]]}', '{"type":"LineString","coordinates":[[1,2]]}', '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}',
             '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]]]}', '{"type":"Polygon","coordinates":[[[0,0],[1,null],[1,1],[0,0]]]}', "{oops", None, '{"type":"LineString","coordinates":"x"}', '{"type":"LineString","coordinates":[]}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.point_from_geojson(F.col("t")).alias("p"), text.line_from_geojson(F.col("t")).alias("l"), text.polygon_from_geojson(F.col("t")).alias("g"))
    got = {r.i: r for r in df.collect()}
    assert (got[0].p.x, got[0].p.y) == (1, 2) and [(p.x, p.y) for p in got[2].l] == [(1, 2), (3, 4.5)] and [(p.x, p.y) for p in got[4].g[0]] == [(0, 0), (1, 0), (1, 1), (0, 0)] and got[10].l == []
    assert all(got[i].p is None for i in got if i) and all(got[i].l is None for i in got if i not in (2, 10)) and all(got[i].g is None for i in got if i != 4)
    back = df.filter("i IN (0, 2, 4)").select(F.coalesce(text.point_to_geojson(F.col("p")), text.line_to_geojson(F.col("l")), text.polygon_to_geojson(F.col("g"))).alias("t")).collect()
    assert sorted(r.t for r in back) == ['{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.5]]}', '{"type":"Point","coordinates":[1.0,2.0]}', '{"type":"Polygon","coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]}']


def test_wkt_numbers_have_no_exponent(spark):
    values = {1e7: "10000000.0", 12345678.25: "12345678.25", -9.876543210987654e8: "-987654321.0987654", 5e-4: "0.0005", 0.0: "0.0", 1234.5: "1234.5", 9007199254740993.0: "9007199254740992.0", 1e16: "1.0E16", 1e-5: "1.0E-5"}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", "v", text.point_to_wkt(F.struct(F.col("v").alias("x"), F.lit(1.0).alias("y"))).alias("t"))
    got = df.select("i", "v", "t", text.point_from_wkt(F.col("t"))["x"].alias("back")).orderBy("i").collect()
    assert [r.t for r in got] == [f"POINT ({t} 1.0)" for t in values.values()] and all(r.v == r.back for r in got)


def test_many_overlays_at_once_equal_single_ones():
    """Notched squares and squares with holes, turned or not, at steps where sides and corners often fall together."""
    import numpy as np

    rnd = random.Random(8)

    def shape(x, y, odd, c, s):
        rings = [[(0, 0), (400, 0), (400, 400), (0, 400)], [(100, 60), (250, 60), (250, 180), (100, 180)]] if odd else [[(0, 0), (400, 0), (400, 280), (250, 280), (250, 400), (0, 400)]]
        return overlay.sides([[((x + a) * c - (y + b) * s, (x + a) * s + (y + b) * c) for a, b in r] for r in rings])

    for c, s in ((1, 0), (0.6, 0.8)):
        for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):
            at = [(x := rnd.randrange(9000), y := rnd.randrange(9000), x + rnd.randrange(-42, 43) * 10, y + rnd.randrange(-42, 43) * 10) for _ in range(150)]
            p, q = [shape(x, y, i, c, s) for x, y, _, _ in at], [shape(x, y, j, c, s) for _, _, x, y in at]

            def single(a, b):
                eps = 1e-9 * float(np.abs(np.vstack([a, b])).max())
                (pp, pw), (qp, qw) = overlay._pieces(a, b, eps), overlay._pieces(b, a, eps)
                return [overlay.area_of(np.vstack([pp[(pw == k) | (pw == 2)], qp[qw == k]])) for k in (1, 0)]

            got = np.column_stack(overlay.overlay_areas(np.array(p), np.array(q)))
            assert got == pytest.approx(np.array([single(a, b) for a, b in zip(p, q, strict=True)]), abs=1e-6)


def test_hulls_with_sides_in_common_share_them_once(spark):
    """Sides that two hulls have in common, away from both axes, bound what they share once."""
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    hulls = [(1, ring((0, 0), (10, 0), (10, 10), (0, 10)), 100.0), (2, ring((4, 2), (10, 2), (10, 8), (4, 8)), 36.0), (3, ring((0, 0), (10, 0), (10, 10), (0, 10)), 100.0)]
    got = {(r.i, r.j): (r.shared, r.mean_overlap) for r in spatial.hull_overlaps(spark.createDataFrame(hulls, f"cluster long, hull {spatial.HULL}, area double")).collect()}
    assert got[1, 2] == pytest.approx((36, 0.68)) and got[1, 3] == pytest.approx((100, 1)) and got[2, 3] == pytest.approx((36, 0.68))
