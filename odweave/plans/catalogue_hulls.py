"""Registered queries on hulls, matchings, projections and the catalog, with SQL that finds the same by other means."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import spatial
from ..sources import catalog, readers, sinks
from ..sources import fixtures as fx
from . import oracles as o
from .catalogue import cluster_hulls, cluster_matching, cluster_overlap
from .catalogue_more import _custom, silhouette_curve
from .catalogue_more import cluster_matching_table as matching_rows

QUERIES = {}
ORACLES = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# Hulls. In SQL a side of a hull is a pair of points that has no point to its right and no further one on its line.


def _hull(name: str, x: str, y: str) -> str:
    """{name}(cluster, ax, ay, bx, bt): the sides of hulls of trips' ends, counter-clockwise; {name}_f has their figures. Points inside the box of four extremes are left out first."""
    cross = "(b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)"
    bad = f"{cross} < 0 OR ({cross} = 0 AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - b.x) * (b.x - a.x) + (c.y - b.y) * (b.y - a.y) > 0))"
    box = ", ".join(f"arg_{m}({{'x': x, 'y': y}}, {e}) AS {n}" for n, m, e in (("p1", "min", "x + y"), ("p2", "max", "x - y"), ("p3", "max", "x + y"), ("p4", "min", "x - y")))
    out = " OR ".join(f"({q}.x - {p}.x) * (d.y - {p}.y) - ({q}.y - {p}.y) * (d.x - {p}.x) <= 0" for p, q in (("p1", "p2"), ("p2", "p3"), ("p3", "p4"), ("p4", "p1")))
    return f"""{name}_d AS (SELECT DISTINCT cluster::BIGINT AS cluster, {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM trips),
{name}_b AS (SELECT cluster, count(*) AS n, {box} FROM {name}_d GROUP BY cluster), {name}_c AS (SELECT d.* FROM {name}_d d JOIN {name}_b USING (cluster) WHERE {out}),
{name} AS (SELECT a.cluster, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bt FROM {name}_c a JOIN {name}_c b ON a.cluster = b.cluster AND (a.x <> b.x OR a.y <> b.y) JOIN {name}_c c ON c.cluster = a.cluster GROUP BY ALL HAVING count(*) FILTER ({bad}) = 0),
{name}_s AS (SELECT *, ax * bt - bx * ay AS w FROM {name}),
{name}_f AS (SELECT cluster, count(*)::INT AS n_sides, sum(w) / 2 AS area, sum(w * (ax + bx)) / (3 * sum(w)) AS cx, sum(w * (ay + bt)) / (3 * sum(w)) AS cy, any_value(n) AS n_points, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1
    FROM {name}_s JOIN {name}_b USING (cluster) GROUP BY cluster HAVING sum(w) > 0)"""


def _shared(a: str, b: str) -> str:
    """sh(i, j, shared): by Green's theorem over the parts of each hull's sides that lie in the other hull."""
    return f"""ed AS (SELECT a.cluster AS i, b.cluster AS j, a.ax, a.ay, a.bx, a.bt, b.ax AS sx, b.ay AS sy, b.bx AS ex, b.bt AS ey FROM {a} a, {b} b UNION ALL SELECT a.cluster, b.cluster, b.ax, b.ay, b.bx, b.bt, a.ax, a.ay, a.bx, a.bt FROM {a} a, {b} b),
nm AS (SELECT i, j, ax, ay, bx - ax AS vx, bt - ay AS vy, (ex - sx) * (ay - sy) - (ey - sy) * (ax - sx) AS num, (ex - sx) * (bt - ay) - (ey - sy) * (bx - ax) AS den FROM ed),
ct AS (SELECT i, j, ax, ay, vx, vy, greatest(0.0::DOUBLE, coalesce(max(-num / den) FILTER (den > 0), 0)) AS t0, least(1.0::DOUBLE, coalesce(min(-num / den) FILTER (den < 0), 1)) AS t1, bool_and(den <> 0 OR num >= 0) AS ok FROM nm GROUP BY i, j, ax, ay, vx, vy),
sh AS (SELECT i, j, coalesce(sum((ax + t0 * vx) * (ay + t1 * vy) - (ax + t1 * vx) * (ay + t0 * vy)) FILTER (ok AND t1 > t0), 0) / 2 AS shared FROM ct GROUP BY i, j)"""


_MEET = "x.x0 <= y.x1 AND y.x0 <= x.x1 AND x.y0 <= y.y1 AND y.y0 <= x.y1"


@query(f"WITH {o._TRIPS}, {_hull('ha', 'ox', 'oy')} SELECT cluster, n_sides, round(area, 1) AS area, round(cx, 6) AS cx, round(cy, 6) AS cy, n_points FROM ha_f")
def hull_figures(spark, d):  # noqa: ANN001, ANN201
    return cluster_hulls(spark, d).select("cluster", F.size("hull").alias("n_sides"), F.round("area", 1).alias("area"), F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "n_points")


@query(f"""WITH {o._TRIPS}, {_hull('ha', 'ox', 'oy')}, {_shared('ha', 'ha')}
SELECT i, j, round(shared, 1) AS shared, round(1 - shared / (x.area + y.area - shared), 9) AS jaccard_distance, round((shared / x.area + shared / y.area) / 2, 9) AS mean_overlap FROM sh JOIN ha_f x ON x.cluster = i JOIN ha_f y ON y.cluster = j WHERE i < j AND {_MEET}""")
def overlap_figures(spark, d):  # noqa: ANN001, ANN201
    return cluster_overlap(spark, d).select("i", "j", F.round("shared", 1).alias("shared"), F.round("jaccard_distance", 9).alias("jaccard_distance"), F.round("mean_overlap", 9).alias("mean_overlap"))


_MATCHES = f"""WITH {o._TRIPS}, {_hull('ha', 'ox', 'oy')}, {_hull('hb', 'dx', 'dy')}, {_shared('ha', 'hb')},
mo AS (SELECT cluster, avg(ox) AS ox, avg(oy) AS oy FROM (SELECT DISTINCT cluster, ox, oy FROM trips) GROUP BY cluster), md AS (SELECT cluster, avg(dx) AS dx, avg(dy) AS dy FROM (SELECT DISTINCT cluster, dx, dy FROM trips) GROUP BY cluster),
an AS (SELECT cluster, CASE WHEN a < 0 THEN a + 360 ELSE a END AS a FROM (SELECT cluster, degrees(atan2(dy - oy, dx - ox)) AS a FROM mo JOIN md USING (cluster))),
sc AS (SELECT i, j, (shared / x.area + shared / y.area) / 2 AS mean_overlap, abs(p.a - q.a) % 180 AS turn FROM sh JOIN ha_f x ON x.cluster = i JOIN hb_f y ON y.cluster = j JOIN an p ON p.cluster = i JOIN an q ON q.cluster = j WHERE sqrt((x.cx - y.cx) ** 2 + (x.cy - y.cy) ** 2) <= 500),
ra AS (SELECT i, j, mean_overlap + (90 - CASE WHEN turn > 90 THEN 180 - turn ELSE turn END) / 90 AS score FROM sc),
ma AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j)::INT AS rank FROM ra QUALIFY rank <= 3)"""


@query(f"{_MATCHES} SELECT i, j, rank, round(score, 9) AS score FROM ma")
def best_matches(spark, d):  # noqa: ANN001, ANN201
    return cluster_matching(spark, d).withColumn("score", F.round("score", 9))


@query(f"""{_MATCHES}, n AS (SELECT cluster::BIGINT AS c, count(*) AS n FROM trips GROUP BY ALL), tp AS (SELECT i, max(j) FILTER (rank = 1) AS top_1_id, max(j) FILTER (rank = 2) AS top_2_id, max(j) FILTER (rank = 3) AS top_3_id, max(score) FILTER (rank = 1) AS score FROM ma GROUP BY i)
SELECT a.c AS i, top_1_id, top_2_id, top_3_id, round(score, 9) AS score, a.n AS count1, b.n AS count2 FROM n a LEFT JOIN tp ON tp.i = a.c LEFT JOIN n b ON b.c = top_1_id""")
def best_matches_table(spark, d):  # noqa: ANN001, ANN201
    return matching_rows(spark, d).withColumn("score", F.round("score", 9))


# Matchings and curves

_ORDERS = "(1, [1]), (2, [1, 2]), (2, [2, 1]), (3, [1, 2, 3]), (3, [1, 3, 2]), (3, [2, 1, 3]), (3, [2, 3, 1]), (3, [3, 1, 2]), (3, [3, 2, 1])"


@query(f"""WITH {o._TRIPS}, g AS (SELECT trip_id // 3 AS part, trip_id, ox::DOUBLE AS ox, oy::DOUBLE AS oy, dx::DOUBLE AS dx, dy::DOUBLE AS dy, row_number() OVER (PARTITION BY trip_id // 3 ORDER BY trip_id) AS k, count(*) OVER (PARTITION BY trip_id // 3) AS n FROM trips),
w(n, p) AS (VALUES {_ORDERS}), c AS (SELECT a.part, w.p, sum(sqrt((a.ox - b.dx) ** 2 + (a.oy - b.dy) ** 2)) AS cost FROM g a JOIN w ON w.n = a.n JOIN g b ON b.part = a.part AND b.k = w.p[a.k] GROUP BY ALL),
m AS (SELECT part, arg_min(p, cost) AS p FROM c GROUP BY part) SELECT a.part, a.trip_id * 2 - 1 AS origin, b.trip_id * 2 AS dest FROM g a JOIN m ON m.part = a.part JOIN g b ON b.part = a.part AND b.k = m.p[a.k]""")
def matched_trip_ends(spark, d):  # noqa: ANN001, ANN201
    points = spatial.od_points(fx.trips(spark, d), "trip_id").withColumn("part", F.expr("trip_id div 3"))
    return spatial.matched_ends(points.select("part", "id", "type", "x", "y"), "part")


@query(" UNION ALL ".join(
    f"SELECT * FROM ({o._SIL.replace('SELECT flow_id AS id, truth + 1 AS cluster FROM flows', f'SELECT id, cluster_pred AS cluster FROM ({_custom(k)}) WHERE cluster_pred > 0')}, mk AS (SELECT cluster, avg(sil) AS m FROM s GROUP BY cluster) SELECT {k} AS k, round(avg(m), 8) AS mean_sil, count(*) AS n_cluster FROM mk HAVING count(*) > 0)"
    for k in (8, 12)
))
def silhouette_curve_figures(spark, d):  # noqa: ANN001, ANN201
    return silhouette_curve(spark, d).withColumn("mean_sil", F.round("mean_sil", 8))


# Projections, campaign files, the catalog


def _utm_sql() -> str:
    """Easting and northing of (lat, lng) in zone 32 by the transverse Mercator series in powers of the longitude's distance from the middle, which reaches millimetres within a zone."""
    f = 1 / 298.257223563
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    arc = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256 - 175 * e2**4 / 16384, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024 + 105 * e2**4 / 4096, 15 * e2**2 / 256 + 45 * e2**3 / 1024 + 525 * e2**4 / 16384, 35 * e2**3 / 3072 + 175 * e2**4 / 12288]
    m = f"6378137.0::DOUBLE * ({arc[0]!r}::DOUBLE * phi - {arc[1]!r}::DOUBLE * sin(2 * phi) + {arc[2]!r}::DOUBLE * sin(4 * phi) - {arc[3]!r}::DOUBLE * sin(6 * phi))"
    return f"""r AS (SELECT event_id, radians(lat) AS phi, radians(lng - 9) AS lam FROM q), u AS (SELECT event_id, phi, 6378137.0::DOUBLE / sqrt(1 - {e2!r}::DOUBLE * sin(phi) ** 2) AS n, tan(phi) ** 2 AS t, {ep!r}::DOUBLE * cos(phi) ** 2 AS c, lam * cos(phi) AS a, {m} AS m FROM r)
SELECT event_id, round(500000 + 0.9996::DOUBLE * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * {ep!r}::DOUBLE) * a ** 5 / 120), -1) AS easting,
    round(0.9996::DOUBLE * (m + n * tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * {ep!r}::DOUBLE) * a ** 6 / 720)), -1) AS northing FROM u"""


@query(f"WITH q AS (SELECT event_id, 51 + (event_id % 997) / 2000::DOUBLE AS lat, 8.5::DOUBLE + (event_id % 1009) / 1010::DOUBLE AS lng FROM events), {_utm_sql()}")
def projected_points(spark, d):  # noqa: ANN001, ANN201
    e = fx.table(spark, d, "events").select("event_id", (51 + F.col("event_id") % 997 / 2000.0).alias("lat"), (8.5 + F.col("event_id") % 1009 / 1010.0).alias("lng"))
    east, north = geo.utm(F.col("lat"), F.col("lng"))
    return e.select("event_id", F.round(east, -1).alias("easting"), F.round(north, -1).alias("northing"))


@query(f"WITH {o._TRIPS} SELECT trip_id::DOUBLE AS distance_m, date_trunc('second', start_datetime) AS start_datetime, oy / 1000 AS start_lat, 'sr' AS source FROM trips WHERE trip_id % 7 <> 0")
def campaign_rows(spark, d):  # noqa: ANN001, ANN201
    t, at = fx.trips(spark, d), F.col("start_datetime")
    time = F.when(F.col("trip_id") % 7 != 0, F.date_format(at, "HH:mm:ss")).otherwise("none")
    rows = t.select(F.date_format(at, "dd.MM.yyyy").alias("start_date"), time.alias("start_time"), F.date_format(at, "dd.MM.yyyy").alias("end_date"), time.alias("end_time"), F.lit(0).alias("duration [s]"), F.col("trip_id").alias("distance [m]"), (F.col("oy") / 1000).alias("a"), (F.col("ox") / 1000).alias("b"))
    got = readers.campaign_trips(rows, ("a", "b"), ("a", "b"))
    return got.select("distance_m", F.col("start_datetime").cast("timestamp_ntz").alias("start_datetime"), "start_lat", "source")


@query("""SELECT * FROM (VALUES ('cluster_points', 'trips_cl2'), ('cluster_networks', 'trips_cl3'), ('geometry', 'g LINESTRING 25832'), ('mapped', 'trips_mapped'), ('network', 'city_2po_4pgr'),
('raw', 'trips'), ('raw', 'trips_cl2'), ('raw', 'trips_cl3'), ('raw', 'trips_convex'), ('tables', 'city_2po_4pgr'), ('tables', 'city_2po_4pgr_dist'), ('tables', 'trips'), ('tables', 'trips_cl2'), ('tables', 'trips_cl3'), ('tables', 'trips_mapped'), ('here', 'true'), ('rows', (SELECT (2 * count(*))::VARCHAR FROM region))) v(kind, name)""")
def catalog_listing(spark, d):  # noqa: ANN001, ANN201
    """A namespace with tables of each kind is made, listed and dropped again."""
    name = catalog.namespace("q", 1, 2, "mo", 3, 4) + "_" + uuid.uuid4().hex[:8]
    catalog.create_namespace(spark, name)
    try:
        rows = fx.table(spark, d, "region")
        for t in ("trips", "trips_mapped", "trips_cl2", "trips_cl3", "trips_convex", "city_2po_4pgr", "city_2po_4pgr_dist"):
            sinks.write_table(rows, f"`{name}`.{t}")
        sinks.write_table(rows, f"`{name}`.trips", "append")
        found = [("network", catalog.networks(spark, name)), ("raw", catalog.raw_trip_tables(spark, name)), ("mapped", catalog.mapped_trip_tables(spark, name)), ("tables", catalog.tables_in(spark, name)),
                 ("cluster_points", catalog.point_cluster_tables(spark, name)), ("cluster_networks", catalog.network_cluster_tables(spark, name))]
        listed = [(k, n) for k, names in found for n in names]
        listed += [("here", str(name in catalog.namespaces(spark)).lower()), ("rows", str(spark.table(f"`{name}`.trips").count()))]
    finally:
        spark.sql(f"DROP DATABASE `{name}` CASCADE")
    line = catalog.with_srid(spark.range(1).select("id", F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))).alias("g")), "g", 25832)
    listed.append(("geometry", f"{' '.join(catalog.geometry_column(line))} {catalog.srid_of(line, 'g')}"))
    return spark.createDataFrame(listed, "kind string, name string")
