"""DuckDB SQL of the registered queries, built from common table expressions that mirror the fixtures."""

from __future__ import annotations

from ..operators.knn import expected_ratio

#: Parameters of the registered clustering and network queries.
K, EPS, MINPTS, CUTOFF = 15, 7, 6, 5000
SWEEP = [(15, 7, 6), (15, 7, 8), (10, 5, 4), (12, 6, 5)]
HULL_RING = [(3000.0, 3000.0), (15000.0, 2000.0), (17000.0, 9000.0), (9000.0, 16000.0), (2000.0, 11000.0)]

_FLOWS = """flows AS (SELECT vec_id + 1 AS flow_id, CAST(round(CAST(embedding[1] AS DOUBLE) * 10000) AS INT) AS ox, CAST(round(CAST(embedding[2] AS DOUBLE) * 10000) AS INT) AS oy,
    CAST(round(CAST(embedding[3] AS DOUBLE) * 10000) AS INT) AS dx, CAST(round(CAST(embedding[4] AS DOUBLE) * 10000) AS INT) AS dy, label AS truth FROM embeddings)"""
_ENDS = """ends AS (SELECT a.flow_id AS i, b.flow_id AS j, sqrt(((a.ox - b.ox) * (a.ox - b.ox) + (a.oy - b.oy) * (a.oy - b.oy))::DOUBLE) AS o, sqrt(((a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy))::DOUBLE) AS e,
    sqrt(((a.ox - a.dx) * (a.ox - a.dx) + (a.oy - a.dy) * (a.oy - a.dy))::DOUBLE) AS li, sqrt(((b.ox - b.dx) * (b.ox - b.dx) + (b.oy - b.dy) * (b.oy - b.dy))::DOUBLE) AS lj,
    (a.dx - a.ox) * (b.dx - b.ox) + (a.dy - a.oy) * (b.dy - b.oy) AS dot, degrees(atan2(a.dy - a.oy, a.dx - a.ox)) AS ai, degrees(atan2(b.dy - b.oy, b.dx - b.ox)) AS aj
    FROM flows a JOIN flows b ON a.flow_id < b.flow_id)"""
_D = "(round_even(o, 0) + round_even(e, 0))::INT"
_MEASURES = {
    "manhattan": _D, "manhattan_exact": "o + e", "chebyshev": "greatest(round_even(o, 0), round_even(e, 0))::INT", "euclid4d": "round_even(sqrt(o * o + e * e), 0)::INT",
    "length": "round_even(abs(li - lj), 0)::INT", "direction": "1.0::DOUBLE - dot / nullif(li * lj, 0)", "euclid4d_norm": "sqrt((o * o + e * e) / nullif(li * lj, 0))",
}


def _pairs(d: str = _D) -> str:
    return f"{_FLOWS}, {_ENDS}, p AS (SELECT i, j, {d} AS d FROM ends)"


def _sum(digits: int | None = None, source: str = "p") -> str:
    s, low, high = ("sum(d)::BIGINT", "min(d)", "max(d)") if digits is None else (f"round(sum(d), {digits})", "round(min(d), 6)", "round(max(d), 6)")
    return f"SELECT i, count(d) AS n, {s} AS sum_d, {low} AS min_d, {high} AS max_d FROM {source} GROUP BY i"


def _near(k: int, pairs: str = "p", kind: str = "INT") -> str:
    return f"""b AS (SELECT i, j, d FROM {pairs} UNION ALL SELECT j, i, d FROM {pairs}),
k AS (SELECT * FROM (SELECT i AS ref, j AS nn, CAST(trunc(d) AS {kind}) AS distance, row_number() OVER (PARTITION BY i ORDER BY trunc(d), j) AS rank FROM b) WHERE rank <= {k})"""


_NEAR_DOUBLE = f"""b AS (SELECT i, j, d FROM p UNION ALL SELECT j, i, d FROM p),
k AS (SELECT * FROM (SELECT i AS ref, j AS nn, d AS distance, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM b) WHERE rank <= {K})"""
_PLANAR = f"""{_FLOWS}, e2 AS (SELECT vec_id + 1 AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
p AS (SELECT a.id AS i, b.id AS j, sqrt(0.0::DOUBLE + (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM e2 a JOIN e2 b ON a.id < b.id)"""


def _edges(eps: int) -> str:
    return f"""sh AS (SELECT a.ref AS f, a.nn AS t, a.rank, count(c.nn) AS s FROM k a LEFT JOIN k b ON b.ref = a.nn LEFT JOIN k c ON c.ref = a.ref AND c.nn = b.nn GROUP BY a.ref, a.nn, a.rank),
e AS (SELECT f, t, rank FROM sh WHERE s >= {eps})"""


def _labels(minpts: int) -> str:
    return f"""core AS (SELECT f AS id FROM e GROUP BY f HAVING count(*) >= {minpts}),
ce AS (SELECT f, t FROM e WHERE f IN (SELECT id FROM core) AND t IN (SELECT id FROM core)),
ue AS (SELECT f, t FROM ce UNION SELECT t, f FROM ce),
r(a, b) AS (SELECT f, f FROM ue UNION SELECT r.a, ue.t FROM r JOIN ue ON r.b = ue.f),
cc AS (SELECT a AS id, min(b) AS comp FROM r GROUP BY a),
fi AS (SELECT comp, min(ce.f) AS first FROM ce JOIN cc ON cc.id = ce.f GROUP BY comp),
lab AS (SELECT cc.id, nr.label FROM cc JOIN (SELECT comp, row_number() OVER (ORDER BY first) AS label FROM fi) nr USING (comp))"""


_ASSIGN = """re AS (SELECT DISTINCT t AS id FROM e WHERE f IN (SELECT id FROM core)),
dn AS (SELECT k.ref AS id, arg_min(lab.label, k.rank) AS given FROM k JOIN lab ON lab.id = k.nn GROUP BY k.ref),
cl AS (SELECT flow_id AS id, CAST(CASE WHEN re.id IS NULL THEN 0 ELSE coalesce(lab.label, dn.given, 0) END AS INT) AS cluster_pred
    FROM flows LEFT JOIN re ON re.id = flow_id LEFT JOIN lab ON lab.id = flow_id LEFT JOIN dn ON dn.id = flow_id)"""


def _snn(pairs: str, near: str, eps: int = EPS, minpts: int = MINPTS) -> str:
    return f"WITH RECURSIVE {pairs}, {near}, {_edges(eps)}, {_labels(minpts)}, {_ASSIGN}"


_DENSE = """co AS (SELECT id FROM ids LEFT JOIN (SELECT f, count(*) AS n FROM nr GROUP BY f) c ON c.f = id WHERE coalesce(n, 0) + 1 >= {minpts}),
be AS (SELECT f, t FROM nr WHERE f IN (SELECT id FROM co) AND t IN (SELECT id FROM co)),
r(a, b) AS (SELECT id, id FROM co UNION SELECT r.a, be.t FROM r JOIN be ON r.b = be.f),
lb AS (SELECT id, dense_rank() OVER (ORDER BY comp) AS label FROM (SELECT a AS id, min(b) AS comp FROM r GROUP BY a)),
bo AS (SELECT nr.f AS id, arg_min(lb.label, nr.t) AS given FROM nr JOIN lb ON lb.id = nr.t GROUP BY nr.f)
SELECT ids.id, CAST(coalesce(label, given, 0) AS INT) AS cluster_pred FROM ids LEFT JOIN lb USING (id) LEFT JOIN bo USING (id)"""

_GRID = """nd AS (SELECT n AS node, (n - 1) // 20 AS r, (n - 1) % 20 AS c FROM (SELECT unnest(range(1, 401)) AS n)),
ge AS (SELECT r * 19 + c + 1 AS id, node AS source, node + 1 AS target, c * 1000.0::DOUBLE AS x1, r * 1000.0::DOUBLE AS y1, (c + 1) * 1000.0::DOUBLE AS x2, r * 1000.0::DOUBLE AS y2 FROM nd WHERE c < 19
    UNION ALL SELECT 380 + r * 20 + c + 1, node, node + 20, c * 1000.0::DOUBLE, r * 1000.0::DOUBLE, c * 1000.0::DOUBLE, (r + 1) * 1000.0::DOUBLE FROM nd WHERE r < 19)"""
_THIN = f"{_GRID}, te AS (SELECT id, source, target FROM ge WHERE id % 3 <> 0)"
_THIN_CC = f"{_THIN}, ue AS (SELECT source AS f, target AS t FROM te UNION SELECT target, source FROM te), r(a, b) AS (SELECT f, f FROM ue UNION SELECT r.a, ue.t FROM r JOIN ue ON r.b = ue.f), cc AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a)"
_ND = f"ds AS (SELECT a.node AS source, b.node AS target, (1000 * (abs(a.r - b.r) + abs(a.c - b.c)))::INT AS m FROM nd a JOIN nd b ON 1000 * (abs(a.r - b.r) + abs(a.c - b.c)) <= {CUTOFF})"
_TRIPS = """trips AS (SELECT event_id AS trip_id, (event_id * 7919 + user_id * 31) % 19001 AS ox, (event_id * 6271 + 17) % 19001 AS oy, (event_id * 4001 + user_id * 101) % 19001 AS dx, (event_id * 3571 + 5) % 19001 AS dy,
    ts::TIMESTAMP AS start_datetime, event_type AS direction, CAST(user_id % 10 + 1 AS INT) AS cluster, user_id, value FROM events)"""


def _snap(points: str) -> str:
    """sn(id, edge_id, dist, cx, cy, s, e, src, tgt) of points(id, x, y)."""
    return f"""pe AS (SELECT q.id, q.x, q.y, ge.*, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((q.x - x1) * (x2 - x1) + (q.y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t
    FROM {points} q JOIN (SELECT id AS edge_id, source, target, x1, y1, x2, y2 FROM ge) ge ON abs(q.x - (x1 + x2) / 2) <= 1000 AND abs(q.y - (y1 + y2) / 2) <= 1000),
pc AS (SELECT *, x1 + t * (x2 - x1) AS cx, y1 + t * (y2 - y1) AS cy FROM pe),
pd AS (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS dist FROM pc),
sn AS (SELECT id, edge_id, dist, cx, cy, source AS src, target AS tgt, round_even(sqrt((cx - x1) * (cx - x1) + (cy - y1) * (cy - y1)), 0)::INT AS s, round_even(sqrt((cx - x2) * (cx - x2) + (cy - y2) * (cy - y2)), 0)::INT AS e
    FROM pd QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, edge_id) = 1)"""


_POINTS = """fp AS (SELECT flow_id, flow_id * 2 - 1 AS id, 'origin' AS type, ((ox * 3 + 9500) % 19001 + 19001) % 19001 AS x, ((oy * 3 + 9500) % 19001 + 19001) % 19001 AS y FROM flows
    UNION ALL SELECT flow_id, flow_id * 2, 'dest', ((dx * 3 + 9500) % 19001 + 19001) % 19001, ((dy * 3 + 9500) % 19001 + 19001) % 19001 FROM flows),
fq AS (SELECT flow_id, id, type, x::DOUBLE AS x, y::DOUBLE AS y FROM fp)"""
_FOUR = "least(a.s + b.s + ss.m, a.e + b.e + tt.m, a.s + b.e + st.m, a.e + b.s + ts.m)"


def _network(left: str, right: str, keep: str, name: str) -> str:
    return f"""{name} AS (SELECT a.id AS i, b.id AS j, abs(b.s - a.s) AS d FROM {left} a JOIN {right} b ON a.edge_id = b.edge_id AND {keep}
    UNION ALL SELECT a.id, b.id, {_FOUR} FROM {left} a JOIN {right} b ON {keep} AND a.edge_id <> b.edge_id
    JOIN ds ss ON ss.source = a.src AND ss.target = b.src JOIN ds tt ON tt.source = a.tgt AND tt.target = b.tgt JOIN ds st ON st.source = a.src AND st.target = b.tgt JOIN ds ts ON ts.source = a.tgt AND ts.target = b.src)"""


_FLOW_NET = f"""{_FLOWS}, {_GRID}, {_ND}, {_POINTS}, {_snap("fq")}, og AS (SELECT fq.flow_id AS id, sn.* EXCLUDE (id) FROM sn JOIN fq USING (id) WHERE type = 'origin'), de AS (SELECT fq.flow_id AS id, sn.* EXCLUDE (id) FROM sn JOIN fq USING (id) WHERE type = 'dest'),
{_network("og", "og", "a.id < b.id", "no")}, {_network("de", "de", "a.id < b.id", "ne")}"""


def _ring(x: str, y: str) -> str:
    sides = zip(HULL_RING, [*HULL_RING[1:], HULL_RING[0]], strict=True)
    return "(" + " AND ".join(f"({bx} - {ax}) * ({y} - {ay}) - ({by} - {ay}) * ({x} - {ax}) >= 0" for (ax, ay), (bx, by) in sides) + ")"


def _complete(part: str, low: int, high: int) -> str:
    return f"""WITH {_TRIPS}, n AS (SELECT {part} AS part, direction, count(*) AS n FROM trips GROUP BY ALL), q AS (SELECT DISTINCT direction FROM trips)
SELECT s.part::INT AS part, q.direction, coalesce(n.n, 0)::BIGINT AS n FROM (SELECT unnest(range({low}, {high + 1})) AS part) s CROSS JOIN q LEFT JOIN n ON n.part = s.part AND n.direction = q.direction"""


def _variance(part: str) -> str:
    return f"WITH {_TRIPS}, n AS (SELECT cluster, {part} AS part, count(*) AS n FROM trips GROUP BY ALL) SELECT cluster, round(var_samp(n), 9) AS variance FROM n GROUP BY cluster"


_GEOM = f"""{_FLOWS}, {_ENDS}, q AS (SELECT i, j, {_D}::DOUBLE AS f, abs(CASE WHEN ai < 0 THEN ai + 360 ELSE ai END - CASE WHEN aj < 0 THEN aj + 360 ELSE aj END) AS t, abs(li - lj) AS g FROM ends),
p AS (SELECT i, j, (f - min(f) OVER ()) / (max(f) OVER () - min(f) OVER ()) + (t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()) + (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) AS d FROM q)"""


def _silhouettes(pairs: str) -> str:
    """s(id, cluster, sil) of flows by p(i, j, d)."""
    return f"""WITH {pairs}, b AS (SELECT i, j, d FROM p UNION ALL SELECT j, i, d FROM p), l AS (SELECT flow_id AS id, truth + 1 AS cluster FROM flows),
m AS (SELECT i, a.cluster AS ci, c.cluster AS cj, avg(d) AS m FROM b JOIN l a ON a.id = i JOIN l c ON c.id = j GROUP BY ALL),
ab AS (SELECT i, ci, max(m) FILTER (ci = cj) AS a, min(m) FILTER (ci <> cj) AS b FROM m GROUP BY ALL),
s AS (SELECT i AS id, ci AS cluster, CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS sil FROM ab JOIN (SELECT cluster, count(*) AS n FROM l GROUP BY cluster) z ON z.cluster = ci WHERE b IS NOT NULL)"""


_SIL, _SIL_GEOM = _silhouettes(_pairs()), _silhouettes(_GEOM)


def _external(table: str) -> str:
    """x: one row of sums from table(a, b)."""
    return f"""t AS (SELECT a, b, count(*)::DOUBLE AS n FROM {table} GROUP BY ALL),
x AS (SELECT (SELECT sum(n) FROM t) AS total, (SELECT sum(n * (n - 1) / 2) FROM t) AS tp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS pr,
    (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS pc, (SELECT sum(m) FROM (SELECT max(n) AS m FROM t GROUP BY b)) AS top,
    (SELECT sum(n * ln(n)) FROM t) AS hc, (SELECT sum(n * ln(n)) FROM (SELECT sum(n) AS n FROM t GROUP BY a)) AS hr, (SELECT sum(n * ln(n)) FROM (SELECT sum(n) AS n FROM t GROUP BY b)) AS hp),
y AS (SELECT *, total * (total - 1) / 2 AS allp, pc - tp AS fp, pr - tp AS fn, ln(total) - hr / total AS h_t, ln(total) - hp / total AS h_p, ln(total) - hc / total AS h_tp FROM x),
z AS (SELECT *, pr * pc / nullif(allp, 0) AS ex, (pr + pc) / 2 AS most, coalesce((tp - pr * pc / nullif(allp, 0)) / nullif((pr + pc) / 2 - pr * pc / nullif(allp, 0), 0), 1) AS ari FROM y)"""


def _sweep_row(k: int, eps: int, minpts: int) -> str:
    body = _snn(_pairs(), _near(k), eps, minpts)
    return f"""SELECT * FROM ({body}, both_ AS (SELECT cluster_pred AS b, truth AS a FROM cl JOIN flows ON flow_id = id), {_external("both_")}
SELECT {k} AS k, {eps} AS eps, {minpts} AS minpts, round((SELECT ari FROM z), 9) AS ari, (SELECT count(DISTINCT b) FILTER (b <> 0) FROM both_) AS n_cluster, (SELECT count(*) FILTER (b = 0) FROM both_) AS n_noise)"""


_RK = ", ".join(f"({k}, {expected_ratio(k)!r}::DOUBLE)" for k in range(1, 20))

def _mode(x: str, y: str, out: str) -> str:
    """out(cluster, gx, gy): the densest of 50 x 50 places over the points (x, y) of each cluster."""
    side = lambda c: f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, coalesce(stddev_samp({c}), 0) AS sd_{c}, (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / 1.34 AS q_{c}"
    width = lambda c: f"0.9 * coalesce(nullif(least(sd_{c}, q_{c}), 0), nullif(sd_{c}, 0), nullif(abs(lo_{c}), 0), 1) * pow(n, -0.2) AS w_{c}"
    kernel = lambda c, g: f"exp(-0.5 * pow(({g} - f.{c}) / w_{c}, 2))"
    return f"""{out}_s AS (SELECT cluster, count(*)::DOUBLE AS n, {side(x)}, {side(y)} FROM fl GROUP BY cluster), {out}_w AS (SELECT *, {width(x)}, {width(y)} FROM {out}_s),
{out}_g AS (SELECT w.*, i, j, lo_{x} + i * (hi_{x} - lo_{x}) / 49 AS gx, lo_{y} + j * (hi_{y} - lo_{y}) / 49 AS gy FROM {out}_w w, (SELECT unnest(range(50)) AS i), (SELECT unnest(range(50)) AS j)),
{out}_d AS (SELECT g.cluster, i, j, any_value(gx) AS gx, any_value(gy) AS gy, sum({kernel(x, "gx")} * {kernel(y, "gy")}) AS p FROM {out}_g g JOIN fl f ON f.cluster = g.cluster GROUP BY g.cluster, i, j),
{out} AS (SELECT cluster, gx, gy FROM {out}_d QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY p DESC, i, j) = 1)"""


_MODES = f"""fl AS (SELECT truth AS cluster, ox::DOUBLE AS ox, oy::DOUBLE AS oy, dx::DOUBLE AS dx, dy::DOUBLE AS dy FROM flows), {_mode("ox", "oy", "mo")}, {_mode("dx", "dy", "md")}
SELECT mo.cluster, round(mo.gx, 6) AS ox, round(mo.gy, 6) AS oy, round(md.gx, 6) AS dx, round(md.gy, 6) AS dy FROM mo JOIN md USING (cluster)"""

ORACLES: dict[str, str] = {f"flow_pairs_{m}": f"WITH {_pairs(sql)} {_sum({'manhattan_exact': 3, 'direction': 4, 'euclid4d_norm': 3}.get(m))}" for m, sql in _MEASURES.items()}
ORACLES |= {
    "flow_pairs_geom": f"WITH {_GEOM} {_sum(4)}",
    "distance_minmax": f"WITH {_pairs()}, q AS (SELECT i, j, (d - min(d) OVER ())::DOUBLE / (max(d) OVER () - min(d) OVER ()) AS d FROM p) {_sum(4, 'q')}",
    "distance_histogram": f"WITH {_pairs()}, q AS (SELECT (d - min(d) OVER ())::DOUBLE / (max(d) OVER () - min(d) OVER ()) AS d FROM p) SELECT CAST(least(floor(d * 20), 19) AS INT) AS bin, count(*) AS n FROM q GROUP BY ALL",
    "knn_flows": f"WITH {_pairs()}, {_near(K)} SELECT ref, nn, distance, rank::INT AS rank FROM k",
    "knn_flows_double": f"WITH {_PLANAR}, {_NEAR_DOUBLE} SELECT ref, nn, distance, rank::INT AS rank FROM k",
    "knn_wide": f"WITH {_pairs()}, {_near(5)} SELECT flow_id AS ref, {', '.join(f'max(nn) FILTER (rank = {r}) AS NN{r}' for r in range(1, 6))} FROM flows LEFT JOIN k ON ref = flow_id GROUP BY flow_id",
    "knn_distance_rows": f"WITH {_pairs()}, {_near(5)} SELECT ref, {', '.join(f'max(distance) FILTER (rank = {r}) AS NN{r}' for r in range(1, 6))} FROM k GROUP BY ref",
    "snn_density": f"WITH {_pairs()}, {_near(K)}, {_edges(EPS)} SELECT flow_id AS flow, coalesce(n, 0)::INT AS shared_density FROM flows LEFT JOIN (SELECT f, count(*) AS n FROM e GROUP BY f) ON f = flow_id",
    "dr_edges": f'WITH {_pairs()}, {_near(K)}, {_edges(EPS)} SELECT f AS "from", t AS "to", rank::INT AS rank FROM e',
    "core_flows": f"WITH {_pairs()}, {_near(K)}, {_edges(EPS)} SELECT f AS flow, count(*)::INT AS shared_density FROM e GROUP BY f HAVING count(*) >= {MINPTS}",
    "core_components": f"WITH RECURSIVE {_pairs()}, {_near(K)}, {_edges(EPS)}, {_labels(MINPTS)} SELECT id AS flow, label::INT AS label FROM lab",
    "snn_clusters": f"{_snn(_pairs(), _near(K))} SELECT id, cluster_pred FROM cl",
    "snn_clusters_double": f"{_snn(_PLANAR, _NEAR_DOUBLE)} SELECT id, cluster_pred FROM cl",
    "cluster_counts": f"""{_snn(_pairs(), _near(K))}, n AS (SELECT cluster_pred AS c, count(*) AS n FROM cl GROUP BY ALL)
SELECT count(*) FILTER (c <> 0) AS n_cluster, count(*) AS n_cluster_all, coalesce(sum(n) FILTER (c = 0), 0)::BIGINT AS n_noise, avg(n) FILTER (c <> 0) AS mean_size FROM n""",
    "cluster_stats": f"""{_snn(_pairs(), _near(K))}, f AS (SELECT cl.cluster_pred, sqrt(((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy))::DOUBLE) AS m FROM cl JOIN flows ON flow_id = id)
SELECT cluster_pred, count(*) AS n_flows, round(avg(m), 6) AS mean_length, count(*) / sum(count(*)) OVER () AS share FROM f GROUP BY cluster_pred""",
    "flows_in_clusters": f"{_snn(_pairs(), _near(K))} SELECT flow_id, cluster_pred, ox, oy, dx, dy FROM flows JOIN cl ON id = flow_id WHERE cluster_pred IN (1, 2, 5)",
    "knn_of_flows": f"WITH {_pairs()}, {_near(K)} SELECT ref, rank::INT AS rank, distance, flow_id, ox, oy, dx, dy FROM k JOIN flows ON flow_id = nn WHERE ref IN (1, 17, 250) AND rank <= 5",
    "jarvis_patrick_flows": f"""WITH RECURSIVE {_pairs()}, {_near(K)}, ks AS (SELECT ref, nn FROM k UNION ALL SELECT flow_id, flow_id FROM flows),
sh AS (SELECT a.ref AS f, a.nn AS t, count(c.nn) AS s FROM ks a JOIN ks b ON b.ref = a.nn LEFT JOIN ks c ON c.ref = a.ref AND c.nn = b.nn WHERE a.ref <> a.nn GROUP BY a.ref, a.nn),
nr AS (SELECT x.f, x.t FROM sh x JOIN sh y ON x.f = y.t AND x.t = y.f WHERE x.s >= {EPS}), ids AS (SELECT flow_id AS id FROM flows), {_DENSE.format(minpts=MINPTS)}""",
    "dbscan_flows": f"""WITH RECURSIVE {_pairs()}, nr AS (SELECT i AS f, j AS t FROM p WHERE d <= 700 UNION ALL SELECT j, i FROM p WHERE d <= 700), ids AS (SELECT flow_id AS id FROM flows), {_DENSE.format(minpts=7)}""",
    "rkd_curve": f"""WITH {_pairs()}, {_near(20)}, v AS (SELECT rank AS k, var_samp(distance::DOUBLE) AS v FROM k GROUP BY rank), n AS (SELECT k, v, lead(v) OVER (ORDER BY k) AS n FROM v), rk(k, r) AS (VALUES {_RK})
SELECT n.k::INT AS k, round(n.n / nullif(v, 0) / r, 9) AS rkd FROM n JOIN rk ON rk.k = n.k""",
    "kdist_graph": f"WITH {_pairs()}, {_near(K)} SELECT row_number() OVER (ORDER BY distance, ref)::INT AS place, distance FROM k WHERE rank = {K - 1} AND distance < 99999",
    "lof_clean": f"""WITH {_FLOWS}, d AS (SELECT a.truth AS g, a.flow_id AS i, b.flow_id AS j, sqrt(((a.ox - b.ox) * (a.ox - b.ox) + (a.oy - b.oy) * (a.oy - b.oy))::DOUBLE) AS d FROM flows a JOIN flows b ON a.truth = b.truth AND a.flow_id <> b.flow_id),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r, count(*) OVER (PARTITION BY i) AS n FROM d),
q AS (SELECT *, max(CASE WHEN r <= least(ceil(0.75 * (n + 1)), n) THEN d END) OVER (PARTITION BY i) AS kd FROM r),
nb AS (SELECT * FROM q WHERE d <= kd), kd AS (SELECT DISTINCT i, kd FROM nb),
lr AS (SELECT nb.i, coalesce(count(*) / nullif(sum(greatest(d, kd.kd)), 0), 'inf'::DOUBLE) AS lrd FROM nb JOIN kd ON kd.i = nb.j GROUP BY nb.i),
lo AS (SELECT nb.i, avg(CASE WHEN a.lrd = 'inf' AND b.lrd = 'inf' THEN 1 ELSE b.lrd / a.lrd END) AS lof FROM nb JOIN lr a ON a.i = nb.i JOIN lr b ON b.i = nb.j GROUP BY nb.i)
SELECT * FROM (SELECT flow_id AS id, truth, round(coalesce(lof, 1), 6) AS lof FROM flows LEFT JOIN lo ON i = flow_id) WHERE lof < 2""",
    "silhouette_flows": f"{_SIL} SELECT id, cluster, round(sil, 9) AS sil FROM s",
    "silhouette_by_cluster": f"{_SIL} SELECT cluster, round(avg(sil), 9) AS mean_sil FROM s GROUP BY cluster",
    "ari": f"WITH lp AS (SELECT quality AS a, toxic AS b FROM labels), {_external('lp')} SELECT round(ari, 9) AS ari FROM z",
    "external_indices": f"""WITH lp AS (SELECT quality AS a, toxic AS b FROM labels), {_external('lp')} SELECT round((tp + allp - tp - fp - fn) / allp, 8) AS rand, round(ari, 8) AS ari, round(tp / (tp + fp + fn), 8) AS jaccard, round(tp / sqrt(pr * pc), 8) AS fowlkes_mallows,
    round(2 * (fp + fn), 8) AS mirkin, round(top / total, 8) AS purity, round((h_tp - h_p) / h_t, 8) AS entropy, round((h_t + h_p - h_tp) / sqrt(h_t * h_p), 8) AS nmi, round((2 * h_tp - h_t - h_p) / h_tp, 8) AS nvi,
    round((allp * tp - pr * pc) / sqrt(pr * pc * (allp - pr) * (allp - pc)), 8) AS hubert FROM z""",
    "internal_indices": f"""WITH {_pairs("o + e")}, c AS (SELECT truth AS c, count(*) AS n, avg(ox) AS a, avg(oy) AS b, avg(dx) AS cc, avg(dy) AS dd FROM flows GROUP BY truth), g AS (SELECT count(*) AS total, count(DISTINCT truth) AS k, avg(ox) AS a, avg(oy) AS b, avg(dx) AS cc, avg(dy) AS dd FROM flows),
w AS (SELECT truth AS c, sum((ox - a) ** 2 + (oy - b) ** 2 + (dx - cc) ** 2 + (dy - dd) ** 2) AS ss, avg(sqrt((ox - a) ** 2 + (oy - b) ** 2 + (dx - cc) ** 2 + (dy - dd) ** 2)) AS spread FROM flows JOIN c ON c.c = truth GROUP BY truth),
bt AS (SELECT sum(n * ((c.a - g.a) ** 2 + (c.b - g.b) ** 2 + (c.cc - g.cc) ** 2 + (c.dd - g.dd) ** 2)) AS bt FROM c, g), m AS (SELECT c.*, w.spread FROM c JOIN w ON w.c = c.c),
f AS (SELECT x.c, (x.spread + y.spread) AS s, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.cc - y.cc) ** 2 + (x.dd - y.dd) ** 2) AS far FROM m x JOIN m y ON x.c <> y.c),
lp AS (SELECT d, a.truth = b.truth AS same FROM p JOIN flows a ON a.flow_id = i JOIN flows b ON b.flow_id = j), sw AS (SELECT sum(ss) AS w FROM w)
SELECT round((bt / (k - 1)) / (sw.w / (total - k)), 8) AS calinski_harabasz, (SELECT round(avg(r), 8) FROM (SELECT max(s / far) AS r FROM f GROUP BY c)) AS davies_bouldin,
    (SELECT round(min(d) FILTER (NOT same) / max(d) FILTER (same), 8) FROM lp) AS dunn, round(sw.w / (total * (SELECT min(far) FROM f) ** 2), 8) AS xie_beni FROM g, bt, sw""",
    "scatter_density": f"""WITH {_FLOWS}, v AS (SELECT truth AS c, flow_id AS id, ox::DOUBLE AS a, oy::DOUBLE AS b, dx::DOUBLE AS e, dy::DOUBLE AS f FROM flows),
per AS (SELECT c, avg(a) AS a, avg(b) AS b, avg(e) AS e, avg(f) AS f, sqrt(var_pop(a) ** 2 + var_pop(b) ** 2 + var_pop(e) ** 2 + var_pop(f) ** 2) AS spread FROM v GROUP BY c),
sg AS (SELECT sqrt(sum(spread)) / count(*) AS sigma, avg(spread) AS spread FROM per), al AS (SELECT sqrt(var_pop(a) ** 2 + var_pop(b) ** 2 + var_pop(e) ** 2 + var_pop(f) ** 2) AS spread FROM v),
sp AS (SELECT x.c AS ci, y.c AS cj, w, CASE w WHEN 0 THEN x.a WHEN 1 THEN y.a ELSE (x.a + y.a) / 2 END AS a, CASE w WHEN 0 THEN x.b WHEN 1 THEN y.b ELSE (x.b + y.b) / 2 END AS b,
    CASE w WHEN 0 THEN x.e WHEN 1 THEN y.e ELSE (x.e + y.e) / 2 END AS e, CASE w WHEN 0 THEN x.f WHEN 1 THEN y.f ELSE (x.f + y.f) / 2 END AS f FROM per x JOIN per y ON x.c < y.c, (SELECT unnest([0, 1, 2]) AS w)),
nr AS (SELECT ci, cj, w, count(*) FILTER (sqrt((v.a - sp.a) ** 2 + (v.b - sp.b) ** 2 + (v.e - sp.e) ** 2 + (v.f - sp.f) ** 2) < sigma) AS n FROM sp JOIN v ON v.c = ci OR v.c = cj, sg GROUP BY ci, cj, w),
pr AS (SELECT coalesce(max(n) FILTER (w = 2)::DOUBLE / nullif(max(n) FILTER (w < 2), 0), 0) AS r FROM nr GROUP BY ci, cj)
SELECT round(sg.spread / al.spread, 8) AS sd_scat, round(sg.spread / al.spread + (SELECT avg(r) FROM pr), 8) AS s_dbw FROM sg, al""",
    "cvnn": f"""WITH {_pairs()}, l AS (SELECT flow_id AS id, truth AS c FROM flows), b AS (SELECT i, j, d FROM p UNION ALL SELECT j, i, d FROM p),
k AS (SELECT * FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM b) WHERE rank <= 5),
cm AS (SELECT x.c, avg(d) AS m FROM p JOIN l x ON x.id = i JOIN l y ON y.id = j WHERE x.c = y.c GROUP BY x.c), sz AS (SELECT c, count(*) AS n FROM l GROUP BY c),
sp AS (SELECT x.c, count(*) FILTER (x.c <> y.c) AS away FROM k JOIN l x ON x.id = i JOIN l y ON y.id = j GROUP BY x.c)
SELECT (SELECT round(sum(m), 8) FROM cm) AS cvnn_comp, (SELECT round(max(away / (n * 5)), 8) FROM sp JOIN sz USING (c)) AS cvnn_sep""",
    "validity_table": """WITH t AS (SELECT event_type AS distance_measure, user_id % 2 AS clustering_type, user_id % 5 + 2 AS min_cluster_size, event_id AS e FROM events)
SELECT distance_measure, clustering_type, min_cluster_size, round(avg((e * 3 % 101)::DOUBLE), 8) AS n_cl, round(avg((e * 5 % 101)::DOUBLE), 8) AS n_noise, round(avg((e * 7 % 101)::DOUBLE) + avg((e * 11 % 101)::DOUBLE), 8) AS cvnn_index,
    round(avg((e * 13 % 101)::DOUBLE), 8) AS dbcv, round(avg((e * 17 % 101)::DOUBLE), 8) AS sil, round(avg((e * 19 % 101)::DOUBLE), 8) AS db, round(avg((e * 23 % 101)::DOUBLE), 8) AS ch FROM t GROUP BY ALL""",
    "parameter_grid": "SELECT k::INT AS k, eps::INT AS eps, minpts::INT AS minpts FROM (SELECT unnest(range(2, 26)) AS k), (SELECT unnest(range(2, 21)) AS eps), (SELECT unnest(range(2, 21)) AS minpts) WHERE eps < k AND minpts < k",
    "snn_sweep": " UNION ALL ".join(_sweep_row(*g) for g in SWEEP),
    "node_distance_matrix": f"WITH {_GRID}, {_ND} SELECT source, target, m FROM ds",
    "components_of_network": f"WITH RECURSIVE {_THIN_CC} SELECT node, component FROM cc",
    "largest_component": f"WITH RECURSIVE {_THIN_CC}, top AS (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT id, source, target FROM te WHERE source IN (SELECT node FROM cc JOIN top USING (component))",
    "dangling_edges": f"WITH {_THIN}, dg AS (SELECT n, count(*) AS c FROM (SELECT source AS n FROM te UNION ALL SELECT target FROM te) GROUP BY n) SELECT id, source, target FROM te WHERE source IN (SELECT n FROM dg WHERE c > 1) AND target IN (SELECT n FROM dg WHERE c > 1)",
    "shortest_path_lengths": f"WITH {_GRID} SELECT 1::BIGINT AS start, node AS stop, 1000.0::DOUBLE * (r + c) AS m, (r + c)::INT AS n_edges FROM nd",
    "snap_od_points": f"WITH {_TRIPS}, {_GRID}, op AS (SELECT trip_id * 2 - 1 AS id, ox::DOUBLE AS x, oy::DOUBLE AS y FROM trips UNION ALL SELECT trip_id * 2, dx::DOUBLE, dy::DOUBLE FROM trips), {_snap('op')} SELECT id, edge_id, round(dist, 6) AS dist, s AS dist_to_start, e AS dist_to_end FROM sn",
    "point_network_distance": f"WITH {_FLOWS}, {_GRID}, {_ND}, {_POINTS}, {_snap('fq')}, {_network('sn', 'sn', 'a.id < b.id', 'p')} {_sum()}",
    "flow_network_distance": f"WITH {_FLOW_NET} SELECT i, j, no.d + ne.d AS d FROM no JOIN ne USING (i, j)",
    "flow_network_distance_squared": f"WITH {_FLOW_NET} SELECT i, j, no.d::BIGINT * no.d + ne.d::BIGINT * ne.d AS d FROM no JOIN ne USING (i, j)",
    "flow_network_distance_coalesced": f"WITH {_FLOW_NET}, pq AS (SELECT a.flow_id AS i, b.flow_id AS j FROM flows a JOIN flows b ON a.flow_id < b.flow_id), p AS (SELECT i, j, coalesce(no.d, 0) + coalesce(ne.d, 0) AS d FROM pq LEFT JOIN no USING (i, j) LEFT JOIN ne USING (i, j)) {_sum()}",
    "knn_flows_network": f"WITH {_FLOW_NET}, p AS (SELECT i, j, no.d + ne.d AS d FROM no JOIN ne USING (i, j)), {_near(K)} SELECT ref, nn, distance, rank::INT AS rank FROM k",
    "representative_lines": f"WITH {_FLOWS}, {_MODES}",
    "snn_clusters_network": f"{_snn(_FLOW_NET + ', p AS (SELECT i, j, no.d + ne.d AS d FROM no JOIN ne USING (i, j))', _near(K), 3, 2)} SELECT id, cluster_pred FROM cl",
    "sampled_network_points": f"WITH {_GRID}, sp AS (SELECT id, x1, y1, x2, y2, unnest(range(5)) AS place FROM ge) SELECT row_number() OVER (ORDER BY id, place) AS id, id AS edge_id, round(x1 + place / 4 * (x2 - x1), 6) AS x, round(y1 + place / 4 * (y2 - y1), 6) AS y, round(place / 4 * 1000, 6) AS dist_to_start, round((1 - place / 4) * 1000, 6) AS dist_to_end FROM sp",
    "edge_clusters": f"""WITH {_FLOWS}, {_GRID}, {_ND}, {_POINTS}, {_snap('fq')}, og AS (SELECT fq.flow_id AS id, sn.* EXCLUDE (id) FROM sn JOIN fq USING (id) WHERE type = 'origin'),
sm AS (SELECT row_number() OVER (ORDER BY id, place) AS id, id AS edge_id, source AS src, target AS tgt, (place * 500)::INT AS s, (1000 - place * 500)::INT AS e FROM (SELECT *, unnest(range(3)) AS place FROM ge)),
{_network('sm', 'og', '-a.id <> b.id', 'nw')}, ne AS (SELECT i, arg_min(j, (d, j)) AS j FROM nw GROUP BY i), lb AS (SELECT ne.i AS id, truth + 1 AS cluster, sm.edge_id, sm.s, sm.e FROM ne JOIN flows ON flow_id = ne.j JOIN sm ON sm.id = ne.i)
SELECT edge_id AS id, least(arg_min(cluster, (s, id)), arg_min(cluster, (e, id))) AS cluster FROM lb GROUP BY edge_id""",
    "network_cut_at_points": f"""WITH {_FLOWS}, {_GRID}, {_POINTS}, {_snap('fq')}, ct AS (SELECT ge.id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((cx - x1) * (x2 - x1) + (cy - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM sn JOIN ge ON ge.id = sn.edge_id
    UNION SELECT id, unnest([0.0::DOUBLE, 1.0::DOUBLE]) FROM ge), o AS (SELECT id, t, lead(t) OVER w AS to_t, row_number() OVER w AS part FROM ct WINDOW w AS (PARTITION BY id ORDER BY t)) SELECT id, part::INT AS part, round(t, 6) AS from_t, round(to_t, 6) AS to_t FROM o WHERE to_t IS NOT NULL""",
    "trips_in_hull": f"WITH {_TRIPS} SELECT trip_id FROM trips WHERE {_ring('ox', 'oy')} AND {_ring('dx', 'dy')}",
    "trips_touching_polygon": f"WITH {_TRIPS}, q AS (SELECT trip_id, hour(start_datetime) * 60 + minute(start_datetime) AS m FROM trips WHERE {_ring('ox', 'oy')} OR {_ring('dx', 'dy')}) SELECT trip_id, round((m - min(m) OVER ())::DOUBLE / (max(m) OVER () - min(m) OVER ()), 9) AS scaled_minute FROM q",
    "flow_angles": f"WITH {_TRIPS}, a AS (SELECT *, degrees(atan2(dy - oy, dx - ox)) AS a FROM trips) SELECT trip_id, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS angle, round(sqrt(((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy))::DOUBLE), 6) AS trip_distance FROM a",
    "central_lines": f"""WITH {_TRIPS}, o AS (SELECT cluster, avg(ox) AS ox, avg(oy) AS oy FROM (SELECT DISTINCT cluster, ox, oy FROM trips) GROUP BY cluster), d AS (SELECT cluster, avg(dx) AS dx, avg(dy) AS dy FROM (SELECT DISTINCT cluster, dx, dy FROM trips) GROUP BY cluster),
q AS (SELECT *, degrees(atan2(dy - oy, dx - ox)) AS a FROM o JOIN d USING (cluster)) SELECT cluster, round(ox, 6) AS ox, round(oy, 6) AS oy, round(dx, 6) AS dx, round(dy, 6) AS dy, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS angle FROM q""",
    "od_points": f"WITH {_TRIPS} SELECT trip_id * 2 - 1 AS id, trip_id, 'origin' AS type, ox AS x, oy AS y FROM trips UNION ALL SELECT trip_id * 2, trip_id, 'dest', dx, dy FROM trips",
    "od_pair_ranking": f"WITH {_TRIPS}, l AS (SELECT ox % 7 AS o, dx % 7 AS d FROM trips) SELECT least(o, d) || '_' || greatest(o, d) AS pair, count(*) AS n FROM l WHERE o <> 0 AND d <> 0 GROUP BY ALL ORDER BY n DESC, pair LIMIT 40",
    "cluster_day_variance": _variance("start_datetime::DATE"),
    "cluster_hour_variance": _variance("hour(start_datetime)"),
    "trips_per_minute_complete": _complete("minute(start_datetime)", 0, 59),
    "trips_per_hour_complete": _complete("hour(start_datetime)", 0, 23),
    "trips_per_weekday_complete": _complete("isodow(start_datetime)", 1, 7),
    "trips_per_date_complete": f"""WITH {_TRIPS}, n AS (SELECT start_datetime::DATE AS day, direction, count(*) AS n FROM trips GROUP BY ALL), q AS (SELECT DISTINCT direction FROM trips), s AS (SELECT unnest(generate_series(min(start_datetime)::DATE, max(start_datetime)::DATE, INTERVAL 1 DAY))::DATE AS day FROM trips)
SELECT s.day, q.direction, coalesce(n.n, 0)::BIGINT AS n FROM s CROSS JOIN q LEFT JOIN n ON n.day = s.day AND n.direction = q.direction""",
    "direction_profile": f"WITH {_TRIPS} SELECT CASE WHEN cluster IN (1, 3, 5) THEN 'outward' ELSE 'inward' END AS tag, hour(start_datetime)::INT AS hour, count(*) AS n FROM trips WHERE cluster BETWEEN 1 AND 5 GROUP BY ALL",
    "week_numbers": f"WITH {_TRIPS} SELECT ((dayofyear(start_datetime) - 1) // 7 + 1)::INT AS week, weekofyear(start_datetime)::INT AS iso_week, isodow(start_datetime)::INT AS weekday, count(*) AS n FROM trips GROUP BY ALL",
    "availability_series": "SELECT date_trunc('minute', ts::TIMESTAMP) AS time_stamp, CAST(user_id % 10 + 1 AS INT) AS cluster, count(*) AS count FROM events GROUP BY ALL",
    "rel_availability_profile": """WITH s AS (SELECT date_trunc('minute', ts::TIMESTAMP) AS t, CAST(user_id % 10 + 1 AS INT) AS cluster, count(*) AS count FROM events GROUP BY ALL), r AS (SELECT *, count / max(count) OVER (PARTITION BY cluster) AS rel FROM s)
SELECT cluster, strftime(t, '%H:%M') AS time_of_day, weekofyear(t)::INT AS week, round(avg(count), 9) AS mean_count, round(avg(rel), 9) AS mean_rel FROM r WHERE cluster <> 10 GROUP BY ALL""",
    "subset_windows": f'WITH {_FLOWS}, w AS (SELECT flow_id AS org_id, flow_id // 100 AS "window" FROM flows UNION ALL SELECT flow_id, flow_id // 100 - 1 FROM flows WHERE flow_id % 100 = 0) SELECT row_number() OVER (PARTITION BY "window" ORDER BY org_id)::INT AS flow_id, "window", org_id FROM w',
    "filtered_flows": f"WITH {_TRIPS} SELECT row_number() OVER (ORDER BY start_datetime, trip_id) AS flow_id, trip_id FROM trips WHERE (dayofyear(start_datetime) - 1) // 7 + 1 IN (2, 3) AND isodow(start_datetime) IN (2, 3, 4, 5) AND sqrt(((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy))::DOUBLE) >= 250",
    "canonical_trips": f"WITH {_TRIPS} SELECT trip_id::VARCHAR AS trip_id, oy / 1000 AS start_lat, ox / 1000 AS start_lng, dy / 1000 AS end_lat, dx / 1000 AS end_lng, start_datetime, round(sqrt(((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy))::DOUBLE), 6) AS distance_m, NULL::VARCHAR AS gender, 'events' AS source FROM trips",
    "bike_trips": f"""WITH {_TRIPS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_datetime, trip_id) AS n FROM trips), q AS (SELECT user_id, oy, ox, lead(oy) OVER w AS lat, lead(ox) OVER w AS lng FROM n WINDOW w AS (PARTITION BY user_id ORDER BY start_datetime + to_seconds(n)))
SELECT user_id::VARCHAR AS bike_number, oy::DOUBLE AS start_lat, ox::DOUBLE AS start_lng, lat::DOUBLE AS end_lat, lng::DOUBLE AS end_lng, 'nb' AS source FROM q WHERE lat IS NOT NULL""",
    "distance_json_rows": f"""WITH {_pairs()} SELECT i, '{{' || string_agg('"' || j || '":' || d, ',' ORDER BY j) || '}}' AS row FROM p GROUP BY i""",
    "knn_export": f"WITH {_pairs()}, {_near(5)} SELECT ref - 1 AS id, string_agg((nn - 1)::VARCHAR, ',' ORDER BY rank) AS knn_idx, string_agg(distance::VARCHAR, ',' ORDER BY rank) AS knn_dists FROM k GROUP BY ref",
}
