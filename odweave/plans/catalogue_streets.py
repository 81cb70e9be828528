"""Registered queries on a street network that grows with the tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import grid, network, network_growth, spatial
from ..operators.components import connected_components
from ..sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_STREETS = """sb AS (SELECT event_id AS id, user_id AS u, event_id // 2 AS n FROM events),
st AS (SELECT id, n + 1 AS source, CASE WHEN id % 2 = 0 THEN n + 2 ELSE n + 51 END AS target, (200 + u * 7 % 800)::INT AS m, (n % 50) * 1000.0::DOUBLE AS x1, (n // 50) * 1000.0::DOUBLE AS y1,
    (n % 50 + (id + 1) % 2) * 1000.0::DOUBLE AS x2, (n // 50 + id % 2) * 1000.0::DOUBLE AS y2, u FROM sb WHERE u % 4 <> 0 AND (id % 2 = 1 OR n % 50 < 49)),
sl AS (SELECT *, (x1 + x2) / 2 + (u * 37 % 401 - 200) AS bx, (y1 + y2) / 2 + (u * 53 % 401 - 200) AS bq FROM st),
ad AS (SELECT u, v, min(w) AS w FROM (SELECT source AS u, target AS v, m::DOUBLE AS w FROM st UNION ALL SELECT target, source, m FROM st) GROUP BY ALL),
cl AS (SELECT DISTINCT ((source - 1) // 50 // 10) * 5 + (source - 1) % 50 // 10 + 1 AS cluster, least(source, target) AS source, greatest(source, target) AS target FROM st WHERE id % 23 = 0)"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _components(edges: str, out: str, keys: str = "") -> str:
    """out(keys, node, component) of edges(keys, f, t), by passing on the smallest node."""
    k, on = (f"{keys}, ", "".join(f" AND {{0}}.{x.strip()} = {{1}}.{x.strip()}" for x in keys.split(","))) if keys else ("", "")
    e = ", ".join(f"e.{x.strip()}" for x in keys.split(",")) + ", " if keys else ""
    return f"""{out}_e AS (SELECT {k}f, t FROM {edges} UNION SELECT {k}t, f FROM {edges}),
{out}({k}node, component) USING KEY ({k}node) AS (SELECT DISTINCT {k}f, f FROM {out}_e
    UNION SELECT {e}e.t, min(c.component) FROM {out} c JOIN {out}_e e ON e.f = c.node{on.format("e", "c")} JOIN recurring.{out} r ON r.node = e.t{on.format("r", "e")} WHERE c.component < r.component GROUP BY ALL)"""


_STREET_PARTS = f"WITH RECURSIVE {_STREETS}, se AS (SELECT source AS f, target AS t FROM st), {_components('se', 'cc')}"


@query(f"{_STREET_PARTS} SELECT node, component FROM cc")
def street_components(spark, d):  # noqa: ANN001, ANN201
    """N2."""
    return connected_components(fx.streets(spark, d), "source", "target")


@query(f"{_STREET_PARTS}, tp AS (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT id, source, target FROM st WHERE source IN (SELECT node FROM cc JOIN tp USING (component))")
def street_largest_component(spark, d):  # noqa: ANN001, ANN201
    """N3."""
    return network.largest_component(fx.streets(spark, d)).select("id", "source", "target")


@query(f"WITH {_STREETS}, dg AS (SELECT node, count(*) AS n FROM (SELECT source AS node FROM st UNION ALL SELECT target FROM st) GROUP BY node) SELECT id, source, target FROM st WHERE (SELECT n FROM dg WHERE node = source) > 1 AND (SELECT n FROM dg WHERE node = target) > 1")
def street_dangling_edges(spark, d):  # noqa: ANN001, ANN201
    """N5, A13, J13."""
    return network.dangling_removed(fx.streets(spark, d)).select("id", "source", "target")


@query(f"""WITH RECURSIVE {_STREETS}, sp(source, target, d) USING KEY (source, target) AS (SELECT DISTINCT u, u, 0.0::DOUBLE FROM ad
    UNION SELECT c.source, ad.v, min(c.d + ad.w) FROM sp c JOIN ad ON ad.u = c.target LEFT JOIN recurring.sp r ON r.source = c.source AND r.target = ad.v WHERE c.d + ad.w <= 2500 AND (r.d IS NULL OR c.d + ad.w < r.d) GROUP BY ALL)
SELECT source, target, d::INT AS m FROM sp""")
def street_node_distances(spark, d):  # noqa: ANN001, ANN201
    """N1, N4."""
    return network.node_distances(fx.streets(spark, d), 2500)


_GROWN = f"""WITH RECURSIVE {_STREETS}, ce AS (SELECT cluster, source AS f, target AS t FROM cl), {_components("ce", "pc", "cluster")},
sv AS (SELECT cluster FROM pc GROUP BY cluster HAVING count(DISTINCT component) > 1),
rg(cluster, node, s) USING KEY (cluster, node) AS (SELECT cluster, node, {{'d': 0.0::DOUBLE, 'p': component}} FROM pc WHERE cluster IN (SELECT cluster FROM sv)
    UNION SELECT c.cluster, ad.v, min({{'d': c.s.d + ad.w, 'p': c.s.p}}) FROM rg c JOIN ad ON ad.u = c.node LEFT JOIN recurring.rg r ON r.cluster = c.cluster AND r.node = ad.v WHERE r.s IS NULL OR {{'d': c.s.d + ad.w, 'p': c.s.p}} < r.s GROUP BY ALL),
br AS (SELECT x.cluster, x.s.p AS a, y.s.p AS b, min({{'l': x.s.d + ad.w + y.s.d, 'u': x.node, 'v': y.node}}) AS s FROM rg x JOIN ad ON ad.u = x.node JOIN rg y ON y.cluster = x.cluster AND y.node = ad.v WHERE x.s.p < y.s.p GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s.l, a, b) AS k FROM br),
rc(cluster, k, part) AS (SELECT cluster, k, a FROM rk UNION SELECT rc.cluster, rc.k, CASE WHEN e.a = rc.part THEN e.b ELSE e.a END FROM rc JOIN rk e ON e.cluster = rc.cluster AND e.k < rc.k AND (e.a = rc.part OR e.b = rc.part)),
tr AS (SELECT * FROM rk WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.cluster = rk.cluster AND rc.k = rk.k AND rc.part = rk.b)),
pd AS (SELECT x.cluster, x.node, min(y.node) AS pred FROM rg x JOIN ad ON ad.v = x.node JOIN rg y ON y.cluster = x.cluster AND y.node = ad.u WHERE x.s.d > 0 AND y.s.p = x.s.p AND y.s.d + ad.w = x.s.d GROUP BY ALL),
wy(cluster, node) AS (SELECT cluster, unnest([s.u, s.v]) FROM tr UNION SELECT wy.cluster, pd.pred FROM wy JOIN pd USING (cluster, node)),
gr AS (SELECT cluster, source, target FROM cl UNION SELECT cluster, least(s.u, s.v), greatest(s.u, s.v) FROM tr UNION SELECT cluster, least(node, pred), greatest(node, pred) FROM wy JOIN pd USING (cluster, node))"""


@query(f"{_GROWN} SELECT cluster, source, target FROM gr")
def grown_networks(spark, d):  # noqa: ANN001, ANN201
    """N7."""
    return network_growth.grown_networks(fx.streets(spark, d), fx.street_clusters(spark, d))


@query(f"""{_GROWN}, nd AS (SELECT cluster, source AS n FROM gr WHERE cluster IN (SELECT cluster FROM sv) UNION SELECT cluster, target FROM gr WHERE cluster IN (SELECT cluster FROM sv))
SELECT cluster, source, target FROM gr UNION SELECT a.cluster, ad.u, ad.v FROM nd a JOIN ad ON ad.u = a.n AND ad.u < ad.v JOIN nd b ON b.cluster = a.cluster AND b.n = ad.v""")
def grown_networks_induced(spark, d):  # noqa: ANN001, ANN201
    """N7, with all streets between the nodes of a grown network."""
    return network_growth.grown_networks(fx.streets(spark, d), fx.street_clusters(spark, d), induced=True)


# Bent lines and extents of all sizes

_SEGMENTS = f"""{_STREETS}, sg AS (SELECT id AS edge_id, 0 AS seq, x1, y1, bx AS x2, bq AS y2, sqrt((x1 - bx) * (x1 - bx) + (y1 - bq) * (y1 - bq)) AS len, 0.0::DOUBLE AS from_m FROM sl
    UNION ALL SELECT id, 1, bx, bq, x2, y2, sqrt((bx - x2) * (bx - x2) + (bq - y2) * (bq - y2)), sqrt((x1 - bx) * (x1 - bx) + (y1 - bq) * (y1 - bq)) FROM sl),
so AS (SELECT edge_id, seq, x1, y1, x2, y2, from_m, from_m + len AS to_m, sum(len) OVER (PARTITION BY edge_id) AS total FROM sg)"""
_NEAREST = """greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t"""
_STREET_SNAP = f"""{_SEGMENTS}, pt AS (SELECT event_id AS id, ((event_id * 7919 + user_id * 31) % 49001)::DOUBLE AS x, ((event_id * 6271 + 17) % 9001)::DOUBLE AS y FROM events),
p0 AS (SELECT p.id, p.x, p.y, so.*, {_NEAREST} FROM pt p JOIN so ON abs(p.x - (x1 + x2) / 2) <= 3000 AND abs(p.y - (y1 + y2) / 2) <= 3000),
p1 AS (SELECT *, x1 + t * (x2 - x1) AS cx, y1 + t * (y2 - y1) AS cy FROM p0),
p2 AS (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS dist FROM p1),
sn AS (SELECT id, x, y, edge_id, cx, cy, dist, round_even(from_m + sqrt((cx - x1) * (cx - x1) + (cy - y1) * (cy - y1)), 0)::INT AS s, round_even(sqrt((cx - x2) * (cx - x2) + (cy - y2) * (cy - y2)) + (total - to_m), 0)::INT AS e
    FROM p2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, edge_id, seq) = 1)"""


def _street_points(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return fx.table(spark, d, "events").select(e.alias("id"), ((e * 7919 + u * 31) % 49001).cast("double").alias("x"), ((e * 6271 + 17) % 9001).cast("double").alias("y"))


@query(f"WITH {_STREET_SNAP} SELECT id, edge_id, round(dist, 6) AS dist, s AS dist_to_start, e AS dist_to_end FROM sn")
def street_snap(spark, d):  # noqa: ANN001, ANN201
    """J8, G4, G5 on bent lines."""
    return network.snap(_street_points(spark, d), fx.streets(spark, d)).select("id", "edge_id", F.round("dist", 6).alias("dist"), "dist_to_start", "dist_to_end")


@query(f"""WITH {_SEGMENTS}, n AS (SELECT edge_id, total, greatest(1, ceil(total / 300.0))::INT AS n FROM so WHERE seq = 0), b AS (SELECT *, coalesce(sum(n + 1) OVER (ORDER BY edge_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
q AS (SELECT *, unnest(range(n + 1)) AS place FROM b), a AS (SELECT *, place::DOUBLE / n * total AS pos FROM q)
SELECT (before + place + 1)::BIGINT AS id, edge_id, round(x1 + (pos - from_m) / (to_m - from_m) * (x2 - x1), 6) AS x, round(y1 + (pos - from_m) / (to_m - from_m) * (y2 - y1), 6) AS y, round(pos, 6) AS dist_to_start, round((1 - place::DOUBLE / n) * a.total, 6) AS dist_to_end
FROM a JOIN so USING (edge_id) WHERE (seq = 0) = (pos < (SELECT to_m FROM so z WHERE z.edge_id = a.edge_id AND z.seq = 0))""")
def street_samples(spark, d):  # noqa: ANN001, ANN201
    """G10, W1 on bent lines."""
    return network.sampled_points(fx.streets(spark, d), 300.0).select("id", "edge_id", *[F.round(c, 6).alias(c) for c in ("x", "y", "dist_to_start", "dist_to_end")])


@query(f"""WITH {_STREET_SNAP}, c0 AS (SELECT DISTINCT edge_id, cx AS x, cy AS y FROM sn),
c1 AS (SELECT p.x, p.y, so.*, {_NEAREST} FROM c0 p JOIN so USING (edge_id)), c2 AS (SELECT *, x1 + t * (x2 - x1) AS cx, y1 + t * (y2 - y1) AS cy FROM c1),
c3 AS (SELECT edge_id, (from_m + t * (to_m - from_m)) / total AS t FROM c2 QUALIFY row_number() OVER (PARTITION BY edge_id, x, y ORDER BY sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)), seq) = 1),
c4 AS (SELECT edge_id, unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS t FROM (SELECT DISTINCT edge_id FROM so) UNION SELECT * FROM c3),
c5 AS (SELECT edge_id, t AS a, lead(t) OVER w AS b, row_number() OVER w AS part FROM c4 WINDOW w AS (PARTITION BY edge_id ORDER BY t)), f AS (SELECT edge_id, to_m AS bend, total FROM so WHERE seq = 0)
SELECT edge_id AS id, part::INT AS part, round(a, 6) AS from_t, round(b, 6) AS to_t, (2 + (a * total < bend AND bend < b * total)::INT)::INT AS n_points, round((b - a) * total, 3) AS length FROM c5 JOIN f USING (edge_id) WHERE b IS NOT NULL""")
def street_cuts(spark, d):  # noqa: ANN001, ANN201
    """G18 on bent lines: parts with their own points."""
    at = network.snap(_street_points(spark, d), fx.streets(spark, d)).select("edge_id", F.col("cx").alias("x"), F.col("cy").alias("y")).distinct()
    got = network.blended(fx.streets(spark, d), at)
    return got.select("id", "part", F.round("from_t", 6).alias("from_t"), F.round("to_t", 6).alias("to_t"), F.size("line").alias("n_points"), F.round(geo.line_length(F.col("line")), 3).alias("length"))


#: Squares whose sides are 10 metres times 2 to the power of 0 to 15: the largest are some 30,000 times as wide as the smallest.
_SQUARES = "sq AS (SELECT event_id AS id, ((event_id * 7919 + user_id * 31) % 300001)::DOUBLE AS x, ((event_id * 6271 + 17) % 290001)::DOUBLE AS y, 10.0::DOUBLE * (1 << (CASE WHEN event_id % 50 = 0 THEN event_id // 50 % 16 ELSE event_id % 6 END)::INT) AS side FROM events)"


def _squares(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    power = F.when(e % 50 == 0, F.floor(e / 50) % 16).otherwise(e % 6)
    return fx.table(spark, d, "events").select(e.alias("id"), ((e * 7919 + u * 31) % 300001).cast("double").alias("x"), ((e * 6271 + 17) % 290001).cast("double").alias("y"), (F.pow(F.lit(2.0), power) * 10).alias("side"))


@query(f"WITH {_SQUARES} SELECT a.id, count(*) AS n, min(b.id) AS first, max(b.id) AS last FROM sq a JOIN sq b ON a.id <> b.id AND a.x <= b.x + b.side AND b.x <= a.x + a.side AND a.y <= b.y + b.side AND b.y <= a.y + a.side GROUP BY a.id")
def extents_met(spark, d):  # noqa: ANN001, ANN201
    """How many others each of many extents of very different sizes meets."""
    take = lambda s: _squares(spark, d).select(F.col("id").alias(s), grid.box(F.col("x"), F.col("y"), F.col("x") + F.col("side"), F.col("y") + F.col("side")).alias(f"b{s}"))
    met = grid.meeting(take("i"), F.col("bi"), take("j"), F.col("bj")).filter("i <> j")
    return met.groupBy(F.col("i").alias("id")).agg(F.count("*").alias("n"), F.min("j").alias("first"), F.max("j").alias("last"))


@query(f"WITH {_SQUARES}, q AS (SELECT id, x + side / 2 AS cx, y + side / 2 AS cy FROM sq) SELECT p.id AS polygon, count(*) AS n, sum(q.id)::BIGINT AS ids FROM sq p JOIN q ON q.cx >= p.x AND q.cx < p.x + p.side AND q.cy >= p.y AND q.cy < p.y + p.side GROUP BY p.id")
def points_in_extents(spark, d):  # noqa: ANN001, ANN201
    """Points in rings of very different sizes."""
    s = _squares(spark, d)
    at = lambda dx, dy: F.struct((F.col("x") + F.col("side") * dx).alias("x"), (F.col("y") + F.col("side") * dy).alias("y"))
    rings = s.select(F.col("id").alias("polygon"), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("ring"))
    points = s.select("id", (F.col("x") + F.col("side") / 2).alias("x"), (F.col("y") + F.col("side") / 2).alias("y"))
    return spatial.in_polygons(points, rings).groupBy("polygon").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


# Polygons with notches and holes, and geometry as text

#: Squares of 400 with a notch at a corner (even ids) or a hole (odd ids) of 150 by 120, all turned by the angle of a 3-4-5 triangle.
_NOTCHED = "nt AS (SELECT event_id AS id, (event_id * 7919 + user_id * 31) % 90001 AS x, (event_id * 6271 + 17) % 90001 AS y, CASE WHEN event_id % 2 = 0 THEN 250 ELSE 100 END AS nx, CASE WHEN event_id % 2 = 0 THEN 280 ELSE 60 END AS ny FROM events)"
_SHARED = """rect AS (SELECT a.id AS i, b.id AS j, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y, a.x + a.nx AS anx, a.y + a.ny AS any_, b.x + b.nx AS bnx, b.y + b.ny AS bny FROM nt a JOIN nt b ON a.id < b.id AND abs(a.x - b.x) < 400 AND abs(a.y - b.y) < 400),
ar AS (SELECT i, j, greatest(0, least(ax, bx) + 400 - greatest(ax, bx)) * greatest(0, least(ay, b_y) + 400 - greatest(ay, b_y)) AS rr,
    greatest(0, least(bx + 400, anx + 150) - greatest(bx, anx)) * greatest(0, least(b_y + 400, any_ + 120) - greatest(b_y, any_)) AS rn,
    greatest(0, least(ax + 400, bnx + 150) - greatest(ax, bnx)) * greatest(0, least(ay + 400, bny + 120) - greatest(ay, bny)) AS nr,
    greatest(0, least(anx, bnx) + 150 - greatest(anx, bnx)) * greatest(0, least(any_, bny) + 120 - greatest(any_, bny)) AS nn FROM rect),
sh AS (SELECT i, j, (rr - rn - nr + nn)::DOUBLE AS shared FROM ar)"""


def _notched(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    s = fx.table(spark, d, "events").select(e.alias("polygon"), ((e * 7919 + u * 31) % 90001).alias("x"), ((e * 6271 + 17) % 90001).alias("y"))
    at = lambda dx, dy: F.struct(((F.col("x") + dx) * 0.6 - (F.col("y") + dy) * 0.8).alias("x"), ((F.col("x") + dx) * 0.8 + (F.col("y") + dy) * 0.6).alias("y"))
    notch = F.array(F.array(at(0, 0), at(400, 0), at(400, 280), at(250, 280), at(250, 400), at(0, 400)))
    hole = F.array(F.array(at(0, 0), at(400, 0), at(400, 400), at(0, 400)), F.array(at(100, 60), at(250, 60), at(250, 180), at(100, 180)))
    return s.select("polygon", F.when(F.col("polygon") % 2 == 0, notch).otherwise(hole).alias("rings"))


@query(f"WITH {_NOTCHED}, {_SHARED} SELECT i, j, round(shared, 3) AS shared, round(2 * 142000 - shared, 3) AS joined FROM sh WHERE shared > 0")
def notched_overlaps(spark, d):  # noqa: ANN001, ANN201
    """Areas that notched squares and squares with holes share."""
    got = spatial.polygon_overlaps(_notched(spark, d))
    return got.filter("shared > 1e-3").select("i", "j", F.round("shared", 3).alias("shared"), F.round("joined", 3).alias("joined"))


@query(f"""WITH {_STREETS}, w AS (SELECT id, 'LINESTRING (' || x1 || ' ' || y1 || ', ' || bx || ' ' || bq || ', ' || x2 || ' ' || y2 || ')' AS wkt, x1 + bx + x2 AS xs, y1 + bq + y2 AS ys FROM sl)
SELECT id, wkt, 3 AS n_points, round(xs, 6) AS xs, round(ys, 6) AS ys, true AS same FROM w""")
def lines_as_text(spark, d):  # noqa: ANN001, ANN201
    """G6-G8, text geometry: street lines written as WKT and GeoJSON and read again."""
    t = fx.streets(spark, d).select("id", "line", text.line_to_wkt(F.col("line")).alias("wkt"), text.line_to_geojson(F.col("line")).alias("json"))
    t = t.withColumns({"a": text.line_from_wkt(F.col("wkt")), "b": text.line_from_geojson(F.col("json"))})
    total = lambda c: F.round(F.aggregate(F.transform("a", lambda p: p[c]), F.lit(0.0), lambda s, v: s + v), 6)
    return t.select("id", "wkt", F.size("a").alias("n_points"), total("x").alias("xs"), total("y").alias("ys"), ((F.col("a") == F.col("line")) & (F.col("b") == F.col("line"))).alias("same"))


@query(f"WITH {_NOTCHED} SELECT id AS polygon, 1 + id % 2 AS n_rings, CASE WHEN id % 2 = 0 THEN 7 ELSE 10 END AS n_points, 142000.0::DOUBLE AS area, true AS same FROM nt")
def polygons_as_text(spark, d):  # noqa: ANN001, ANN201
    """Text geometry: polygons with notches and holes written as WKT and GeoJSON and read again."""
    closed = F.transform("rings", lambda r: F.concat(r, F.slice(r, 1, 1)))
    t = _notched(spark, d).select("polygon", closed.alias("rings"))
    t = t.withColumns({"a": text.polygon_from_wkt(text.polygon_to_wkt(F.col("rings"))), "b": text.polygon_from_geojson(text.polygon_to_geojson(F.col("rings")))})
    size = F.aggregate(F.transform("a", lambda r: F.size(r)), F.lit(0), lambda s, n: s + n)
    areas = F.transform("a", lambda r: geo.ring_area(r))
    area = 2 * F.get(areas, F.lit(0)) - F.aggregate(areas, F.lit(0.0), lambda s, x: s + x)
    return t.select("polygon", F.size("a").alias("n_rings"), size.alias("n_points"), F.round(area, 3).alias("area"), ((F.col("a") == F.col("rings")) & (F.col("b") == F.col("rings"))).alias("same"))
