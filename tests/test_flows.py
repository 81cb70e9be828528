"""Worked examples and brute-force comparisons of the flow operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from odweave.operators import blocks, clusterers, distance, knn, modes, network, snn, spatial, temporal, validation
from odweave.operators.components import connected_components
from odweave.plans.skew import attach, grouped_prefix, ordered_index

EDGES = [(1, 1, 2, 100), (2, 2, 3, 100), (3, 3, 4, 100)]
POINTS = [(1, 1, 30, 70), (2, 1, 80, 20), (3, 2, 10, 90), (4, 3, 50, 50)]


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, "i long, j long, d int")


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def road(spark):
    edges = spark.createDataFrame(EDGES, "id long, source long, target long, m int")
    points = spark.createDataFrame(POINTS, "id long, edge_id long, dist_to_start int, dist_to_end int")
    return edges, network.with_nodes(points, edges), network.node_distances(edges, 250)


def test_point_distances(spark, road):
    _, points, nodes = road
    got = rows(network.point_distances(points, nodes), "i", "j", "d")
    assert got == [(1, 2, 50), (1, 3, 80), (2, 3, 30), (3, 4, 140)]
    assert rows(network.point_distances(points, nodes, squared=True), "i", "j", "d")[0] == (1, 2, 2500)


def test_node_distances_agree(spark, road):
    edges, _, nodes = road
    other = network.node_distances(edges, 250, broadcast_edges=0)
    assert rows(nodes, "source", "target", "m") == rows(other, "source", "target", "m")
    assert (1, 4, 300) not in rows(nodes, "source", "target", "m") and (2, 2, 0) in rows(nodes, "source", "target", "m")


def test_snn_worked_example(spark):
    p = pairs_of(spark, [(1, 2, 50), (1, 3, 80), (2, 3, 30), (3, 4, 140)])
    ids = spark.range(1, 5).withColumnRenamed("id", "flow_id")
    near = knn.nearest(p, 2)
    assert rows(near, "ref", "rank", "nn") == [(1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 1), (4, 1, 3)]
    assert rows(snn.density(near, ids, "flow_id", 1), "flow", "shared_density") == [(1, 2), (2, 2), (3, 2), (4, 0)]
    assert rows(snn.snn_clusters(p, ids, "flow_id", 2, 1, 2), "id", "cluster_pred") == [(1, 1), (2, 1), (3, 1), (4, 0)]
    assert {r[1] for r in rows(snn.snn_clusters(p, ids, "flow_id", 2, 1, 3), "id", "cluster_pred")} == {0}


def naive_snn(d, n, k, eps, minpts):
    near = {i: [j for _, j in sorted((d[i, j], j) for j in range(1, n + 1) if j != i)][:k] for i in range(1, n + 1)}
    reach = {i: [j for j in near[i] if len(set(near[i]) & set(near[j])) >= eps] for i in near}
    core = {i for i in near if len(reach[i]) >= minpts}
    label, edges = {}, [(i, j) for i in sorted(core) for j in reach[i] if j in core]
    adj = {}
    for i, j in edges:
        adj.setdefault(i, set()).add(j)
        adj.setdefault(j, set()).add(i)
    c = 0
    for i, _ in edges:
        if i not in label:
            c += 1
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = c
                    todo += adj[x]
    reached = {j for i in core for j in reach[i]}
    return [(i, 0 if i not in reached else label[i] if i in label else next((label[j] for j in near[i] if j in label), 0)) for i in near]


@pytest.mark.parametrize("seed,k,eps,minpts", [(1, 6, 3, 3), (2, 8, 4, 3), (3, 5, 2, 4)])
def test_snn_against_naive(spark, seed, k, eps, minpts):
    rnd = random.Random(seed)
    pts = [(rnd.gauss(c, 1), rnd.gauss(c, 1)) for c in (0, 4, 9) for _ in range(20)] + [(rnd.uniform(-5, 15), rnd.uniform(-5, 15)) for _ in range(15)]
    n = len(pts)
    d = {(i, j): int(100 * (abs(pts[i - 1][0] - pts[j - 1][0]) + abs(pts[i - 1][1] - pts[j - 1][1]))) for i in range(1, n + 1) for j in range(1, n + 1)}
    p = pairs_of(spark, [(i, j, d[i, j]) for i, j in itertools.combinations(range(1, n + 1), 2)])
    got = rows(snn.snn_clusters(p, spark.range(1, n + 1).withColumnRenamed("id", "f"), "f", k, eps, minpts), "id", "cluster_pred")
    assert got == naive_snn(d, n, k, eps, minpts)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(500, 500), (None, 3)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "src long, dst long")), "node", "component"))
    par = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in par}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_hot_keys_and_indexes(spark):
    r = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id") % 900).alias("k"))
    dims = r.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = rows(attach(r, dims, "k", "n", F.col("id")), "id", "top")
    want = {x.k: x.top for x in dims.collect()}
    assert got == sorted((x.id, want.get(x.k)) for x in r.collect())
    idx = ordered_index(r, [F.col("k"), F.col("id")], "at", "t").collect()
    order = sorted(idx, key=lambda x: (x.k is None, x.k or 0, x.id))
    assert [x["at"] for x in order] == list(range(3000))
    pre = grouped_prefix(r, ["k"], F.floor(F.col("id") / 100), [F.col("id")], F.lit(1), "before").collect()
    seen = {}
    for x in sorted(pre, key=lambda x: x.id):
        assert x.before == seen.get(x.k, 0)
        seen[x.k] = seen.get(x.k, 0) + 1


def test_ari_and_silhouette(spark):
    same = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 2)], "a int, b int")
    other = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "a int, b int")
    assert validation.adjusted_rand(same, "a", "b").first()[0] == 1
    assert validation.adjusted_rand(other, "a", "b").first()[0] == pytest.approx(-0.5)
    p = pairs_of(spark, [(1, 2, 1), (1, 3, 10), (2, 3, 10)])
    lab = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, cluster int")
    assert rows(validation.silhouette(p, lab), "id", "sil") == [(1, 0.9), (2, 0.9), (3, 0.0)]


def test_network_shapes(spark):
    nets = spark.createDataFrame([(1, 10, 1, 2, 100.0), (1, 11, 2, 3, 100.0)], "cluster long, id long, source long, target long, m double")
    pts = spark.createDataFrame([(1, 5, 10, 40.0, 60.0), (1, 6, 11, 70.0, 30.0)], "cluster long, point long, edge long, to_source double, to_target double")
    outer = network.outer_points(nets, pts)
    assert rows(outer, "node", "point", "distance") == [(1, 5, 40.0), (3, 6, 30.0)]
    assert rows(network.trimmed(nets, outer), "id", "from_m", "to_m") == [(10, 40.0, 100.0), (11, 0.0, 70.0)]


def test_assignment_and_modes():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(20):
        c = rng.integers(0, 50, (5, 6)).astype(float)
        at = spatial.assignment(c)
        assert len(set(at)) == 5
        assert sum(c[i, j] for i, j in enumerate(at)) == min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(6), 5))


def test_hdbscan_and_lof(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, (30, 2)), rng.normal(8, 0.3, (30, 2)), rng.uniform(-20, 30, (6, 2))])
    lab = clusterers.hdbscan_labels(x, 5)
    assert lab[:30].max() == lab[:30].min() == 1 and set(lab[30:60]) == {2}
    df = spark.createDataFrame([(i, 1, float(a), float(b)) for i, (a, b) in enumerate(x[:30])] + [(99, 1, 50.0, 50.0), (100, 2, 0.0, 0.0)], "id long, g int, x double, y double")
    got = dict(rows(clusterers.lof(df, "id", "g", "x", "y"), "id", "lof"))
    assert got[99] > 2 and got[100] == 1.0 and got[0] < 2


def test_pairs_and_windows(spark):
    f = spark.range(1, 41).select(F.col("id").alias("flow_id"), *[F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)).cast("int").alias(c) for c in ("ox", "oy", "dx", "dy")])
    for blocks in (1, 3, 7):
        assert distance.half_pairs(f, "flow_id", blocks).count() == 40 * 39 // 2
    got = temporal.windows_of_ids(spark.range(0, 11).withColumnRenamed("id", "flow"), "flow", 5)
    assert rows(got.filter("window = 0"), "org_id") == [(i,) for i in range(6)]
    assert rows(got.filter("window = 1"), "org_id", "flow") == [(5 + i, 1 + i) for i in range(6)]


def test_nearest_in_cells_is_exact(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.choice([0, 0, 1, 2, 50, 5000]) + rnd.random() * rnd.choice([0, 1, 900]), rnd.random() * rnd.choice([0, 1, 900])) for i in range(1, 160)] + [(900, None, 1.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double").withColumn("rank", F.lit("clash"))
    for k in (1, 4, 200):
        want = []
        for i, x, y in pts[:-1]:
            near = sorted((math.sqrt((x - u) * (x - u) + (y - v) * (y - v)), j) for j, u, v in pts[:-1] if j != i)[:k]
            want += [(i, r + 1, j) for r, (_, j) in enumerate(near)]
        assert rows(knn.nearest_vectors(df, "id", ["x", "y"], k), "ref", "rank", "nn") == sorted(want)
    assert knn.nearest_vectors(df.limit(0), "id", ["x", "y"], 3).count() == 0 and knn.nearest_vectors(df.filter("id = 1"), "id", ["x", "y"], 3).count() == 0


def test_reachable_flows_in_cells(spark):
    rnd = random.Random(8)
    flows = spark.createDataFrame([(i, *[rnd.randrange(-400, 400) for _ in range(4)]) for i in range(120)], "flow_id long, ox int, oy int, dx int, dy int")
    d = distance.measures()["manhattan"]
    got = rows(distance.in_reach(flows, flows, "flow_id", distance.FLOW, d, 300, 1.0), "i", "j", "d")
    half = distance.flow_pairs(flows).filter("d <= 300")
    assert got == sorted(rows(half, "i", "j", "d") + rows(half, "j", "i", "d"))


def test_hull_overlaps_meet_in_cells(spark):
    from odweave.functions import geo

    rnd = random.Random(2)
    pts = []
    for c in range(40):
        x, y, r = rnd.random() * 900, rnd.random() * 900, rnd.choice([5, 40, 300])
        pts += [(c, x + rnd.random() * r, y + rnd.random() * r) for _ in range(12)]
    hulls = spatial.hulls(spark.createDataFrame(pts, "cluster long, x double, y double"), "cluster", batch=5).cache()
    ring = {r.cluster: [(p.x, p.y) for p in r.hull] for r in hulls.collect()}
    for c in range(40):
        assert sorted(ring[c]) == sorted(geo.convex_hull([(x, y) for k, x, y in pts if k == c]))
    plan = spatial.hull_overlaps(hulls)
    got = {(r.i, r.j): r.shared for r in plan.collect()}
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in plan._jdf.queryExecution().toString()
    for i, j in itertools.combinations(range(40), 2):
        assert got.get((i, j), 0.0) == pytest.approx(geo.convex_overlap(ring[i], ring[j]), abs=1e-9)
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    r = spark.range(1).select(geo.ring_area(square).alias("a"), geo.inside_ring(F.lit(2.0), F.lit(2.0), square).alias("notch"), geo.inside_ring(F.lit(1.0), F.lit(1.0), square).alias("inside")).first()
    assert (r.a, r.notch, r.inside) == (10.0, False, True)
    e = spark.range(1).select(geo.ring_area(geo.ellipse(F.lit(5.0), F.lit(1.0), F.lit(3.0), F.lit(2.0), F.lit(0.4), 256)).alias("a")).first().a
    assert e == pytest.approx(math.pi * 6, rel=1e-3)


def test_matching_table(spark):
    m = spark.createDataFrame([(1, 5, 1, 0.9), (1, 6, 2, 0.5), (2, 6, 1, 0.1)], "i long, j long, rank int, score double")
    a, b = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "cluster long, n long"), spark.createDataFrame([(5, 7), (6, 8)], "cluster long, n long")
    assert rows(spatial.matching_table(m, a, b).fillna(-1), "i", "top_1_id", "top_2_id", "top_3_id", "count1", "count2") == [(1, 5, 6, -1, 10, 7), (2, 6, -1, -1, 20, 8), (3, -1, -1, -1, 30, -1)]


def test_silhouette_curve(spark):
    points = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 10.0), (4, 11.0), (5, 30.0)], "id long, x double")
    labels = spark.createDataFrame([(5, 1, 1), (5, 2, 1), (5, 3, 2), (5, 4, 2), (5, 5, 0), (9, 1, 1), (9, 2, 1)], "k int, id long, cluster_pred int")
    got = validation.silhouette_curve(points.selectExpr("id", "x AS ox", "0D AS oy", "x AS dx", "0D AS dy"), "id", ["ox", "oy", "dx", "dy"], labels).collect()
    want = ((21 - 2) / 21 + (19 - 2) / 19) / 2
    assert [(r.k, round(r.mean_sil, 9), r.n_cluster) for r in got] == [(5, round(want, 9), 2)]  # a partner at 2, the others at 21 or 19 in the mean


@pytest.mark.parametrize("block", [7, 4096])
def test_silhouette_in_blocks(spark, block):
    """As from the table of pairs, however points fall into blocks; ties, repeated places, a cluster of one and noise included."""
    rnd = random.Random(6)
    rows_ = [(i, *(rnd.randrange(40) for _ in range(4)), rnd.choice([0, 1, 2, 3])) for i in range(45)] + [(90, 1, 1, 1, 1, 7), (91, 1, 1, 1, 1, 1), (92, 1, 1, 1, 1, 1), (93, None, 1, 1, 1, 1), (94, 1, 2, 3, 4, None)]
    f = spark.createDataFrame(rows_, "flow_id long, ox int, oy int, dx int, dy int, c int")
    sound = f.dropna().persist()
    labels = sound.selectExpr("flow_id AS id", "c AS cluster")
    for drop in (True, False):
        want = {r.id: r.sil for r in validation.silhouette(distance.flow_pairs(sound), labels, drop).collect()}
        got = {r.id: r.sil for r in blocks.silhouette(f, "flow_id", distance.FLOW, "c", drop_noise=drop, block=block).collect()}
        assert got == pytest.approx(want)
    geom = {r.id: r.sil for r in validation.silhouette(distance.geometric_pairs(sound), labels).collect()}
    assert {r.id: r.sil for r in blocks.silhouette(sound, "flow_id", distance.FLOW, "c", blocks.geometric(sound, "flow_id", distance.FLOW, block), block=block).collect()} == pytest.approx(geom)
    assert blocks.silhouette(f.filter("c = 1"), "flow_id", distance.FLOW, "c").count() == 0 and blocks.silhouette(f.limit(0), "flow_id", distance.FLOW, "c").count() == 0


def test_similarity_at_hubs(spark):
    rnd = random.Random(8)
    near = sorted({(a, b) for a in range(40) for b in [99, *rnd.sample(range(40), 4)] if a != b})
    knn_ = spark.createDataFrame([(a, b, 1, 0) for a, b in near], "ref long, nn long, distance int, rank int")
    lists = {}
    for a, b in near:
        lists.setdefault(a, set()).add(b)
    want = sorted((i, j, len(lists[i] & lists[j])) for i in lists for j in lists if i < j and lists[i] & lists[j])
    for hub in (3, 2048):
        assert rows(snn.similarity(knn_, hub), "i", "j", "similarity") == want


def test_lof_by_parts(spark, monkeypatch):
    """However small the parts of a group, and whatever rows have no group, LOF is the same."""
    import numpy as np

    rng = np.random.default_rng(5)
    data = [(i, None if i == 0 else i % 2, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 9, (40, 2)))]
    df = spark.createDataFrame(data, "id long, g int, x double, y double")
    whole = dict(rows(clusterers.lof(df, "id", "g", "x", "y"), "id", "lof"))
    monkeypatch.setattr(clusterers, "LOF_PART", 3)
    monkeypatch.setattr(clusterers, "BROADCAST_GROUPS", 0)
    split = dict(rows(clusterers.lof(df, "id", "g", "x", "y"), "id", "lof"))
    assert whole[0] == 1.0 and set(whole) == set(split) and all(whole[i] == pytest.approx(split[i]) for i in whole)


def test_modes_in_parts(spark):
    """The densest places as found over whole clusters, however their rows are parted; one place, one row and nulls included."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 60), rng.normal(10, 0.2, 120)]).round(3)
    flows = [(1, float(a), float(b), float(c), 5.0) for a, b, c in zip(x, rng.permutation(x), x[::-1] * 2, strict=True)] + [(2, 3.0, 4.0, 5.0, 6.0)] * 3 + [(3, 0.0, 1.0, 0.0, -2.0), (4, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(flows, "c int, ox double, oy double, dx double, dy double")

    def width(a):
        sd, q = (a.std(ddof=1) if len(a) > 1 else 0.0), np.subtract(*np.percentile(a, [75, 25])) / 1.34
        return 0.9 * (min(sd, q) or sd or abs(a[0]) or 1.0) * len(a) ** -0.2

    def mode(a, b):
        gx, gy = np.linspace(a.min(), a.max(), 50), np.linspace(b.min(), b.max(), 50)
        d = np.exp(-0.5 * ((gx[:, None] - a) / width(a)) ** 2) @ np.exp(-0.5 * ((gy[:, None] - b) / width(b)) ** 2).T
        i, j = np.unravel_index(d.argmax(), d.shape)
        return gx[i], gy[j]

    want = {}
    for c in (1, 2, 3):
        ox, oy, dx, dy = (np.array([f[i] for f in flows if f[0] == c]) for i in range(1, 5))
        want[c] = (*mode(ox, oy), *mode(dx, dy))
    for part in (16, 65_536):
        got = {r.cluster: (r.ox, r.oy, r.dx, r.dy) for r in modes.representative_lines(df, "c", part=part).collect()}
        assert got.keys() - want.keys() <= {None} and all(got[c] == pytest.approx(want[c]) for c in want)


def test_groups_are_matched_in_batches(spark, monkeypatch):
    """Groups of all sizes, across Arrow batches, match as each by itself; what takes a call for each group fails."""
    rng = np.random.default_rng(4)
    rows, want, n = [], {}, 0
    for g in [*range(60), None]:
        a, b = (0, 2) if g == 7 else (9, 11) if g == 8 else (int(rng.integers(1, 4)), 4)
        o, d = rng.integers(0, 1000, (a, 2)), rng.integers(0, 1000, (b, 2))
        own = [(g, n + i, "origin", *map(float, p)) for i, p in enumerate(o)] + [(g, n + 50 + i, "dest", *map(float, p)) for i, p in enumerate(d)]
        n += 100
        rows += own
        want[g] = np.hypot(*(o - d[spatial.assignment(np.hypot(o[:, None, 0] - d[None, :, 0], o[:, None, 1] - d[None, :, 1]))]).T).sum() if a else None
    df = spark.createDataFrame(rows, "g long, id long, type string, x double, y double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(type(df.groupBy("g")), "applyInPandas", None)
        got = spatial.matched_ends(df, "g").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    place = {r[1]: (r[0], r[3], r[4]) for r in rows}
    for g in want:
        own = [r for r in got if r.g == g]
        if want[g] is None:
            assert not own
            continue
        assert all(place[r.origin][0] == g == place[r.dest][0] for r in own) and len({r.dest for r in own}) == len({r.origin for r in own}) == sum(r[0] == g and r[2] == "origin" for r in rows)
        assert sum(np.hypot(place[r.origin][1] - place[r.dest][1], place[r.origin][2] - place[r.dest][2]) for r in own) == pytest.approx(want[g])


def test_lof_keeps_no_pairs(spark, monkeypatch):
    """What LOF writes is a multiple of the points: no table has a row for each pair, and none is shuffled."""
    sizes, real = [], clusterers.materialize
    monkeypatch.setattr(clusterers, "materialize", lambda df, label: (sizes.append((out := real(df, label)).count()), out)[1])
    df = spark.range(300).select("id", (F.col("id") % 2).alias("g"), (F.col("id") * 37 % 101).alias("x"), (F.col("id") * 61 % 103).alias("y"))
    got = clusterers.lof(df, "id", "g", "x", "y")
    assert got.count() == 300 and sizes and max(sizes) <= 300 and "Window" not in got._jdf.queryExecution().executedPlan().toString()
