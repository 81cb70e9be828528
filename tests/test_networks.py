"""Sweeps, nearest flows along a network and grown sub-networks against plain evaluations of their definitions."""

import heapq
import itertools
import random

import pytest

from odweave.operators import knn, network, network_growth, network_knn, snn, sweeps, validation


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sweep_labels_and_indices(spark):
    rnd = random.Random(3)
    centres = [(0, 0), (60, 0), (30, 70)]
    pts = [(i, *(c + rnd.gauss(0, 9) for c in rnd.choice(centres))) for i in range(70)]
    points = spark.createDataFrame([(i, x, y, i % 3 if i % 11 else None) for i, x, y in pts], "id long, x double, y double, truth int")
    near = {"plain": knn.nearest_vectors(points, "id", ["x", "y"], 9), "stretched": knn.nearest_vectors(points.selectExpr("id", "x", "y * 3 AS y"), "id", ["x", "y"], 9)}
    near = {m: n.persist() for m, n in near.items()}
    grid = [(9, 3, 3), (9, 4, 5), (7, 3, 2), (5, 2, 3), (3, 2, 2), (9, 8, 8), (4, 0, 1)]
    done = sweeps.Sweep(near, points, "id", grid)
    got = {}
    for r in done.labels().collect():
        got.setdefault((r.dist_measure, r.k, r.eps, r.minpts), {})[r.id] = r.cluster_pred
    figures = {(r.dist_measure, r.k, r.eps, r.minpts): r for r in done.indices(points, "truth").collect()}
    assert len(figures) == 2 * len(grid)
    for m, (k, eps, minpts) in itertools.product(["stretched"], grid[1:4]):
        one = snn.snn_from_knn(near[m].filter(f"rank <= {k}"), points, "id", eps, minpts).join(points, "id").persist()
        assert {r.id: r.cluster_pred for r in one.collect() if r.cluster_pred} == got.get((m, k, eps, minpts), {})
        want, found = validation.external_indices(one, "truth", "cluster_pred").first().asDict(), figures[m, k, eps, minpts]
        assert all(found[c] == pytest.approx(v) if v is not None else found[c] is None for c, v in want.items())
        assert found.n_noise == one.filter("cluster_pred = 0").count() and found.n_cluster == one.filter("cluster_pred > 0").select("cluster_pred").distinct().count()
    with pytest.raises(ValueError, match="minpts"):
        sweeps.Sweep(near, points, "id", [(3, 2, 0)])
    assert len(sweeps.full_grid()) == 3914


def _distances(edges, start):
    best, heap, graph = {}, [(0, start)], {}
    for a, b, w in edges:
        graph.setdefault(a, []).append((b, w))
        graph.setdefault(b, []).append((a, w))
    while heap:
        d, u = heapq.heappop(heap)
        if u not in best:
            best[u] = d
            for v, w in graph.get(u, ()):
                heapq.heappush(heap, (d + w, v))
    return best


def test_nearest_on_network(spark):
    """Equal to the k nearest of all pairs, also where a third of the flows start on one edge, and where pairs are out of reach."""
    rnd = random.Random(7)
    net = [(i, a, b, rnd.randrange(5, 60)) for i, (a, b) in enumerate({tuple(sorted(rnd.sample(range(25), 2))) for _ in range(45)}, 1)] + [(90, 70, 71, 10)]
    edges = spark.createDataFrame(net, "id long, source long, target long, m int")
    lengths = {i: m for i, _, _, m in net}

    def ends():
        out = []
        for f in range(60):
            e = 3 if f % 3 == 0 else rnd.choice(net)[0]
            s = rnd.randrange(0, lengths[e] + 1)
            out.append((f, e, s, lengths[e] - s))
        return network.with_nodes(spark.createDataFrame(out, "id long, edge_id long, dist_to_start int, dist_to_end int"), edges).persist()

    o, d = ends(), ends()
    for k, cutoff in ((3, 400), (5, 60)):
        want = knn.nearest(network.flow_distances(o, d, network.node_distances(edges, cutoff)), k)
        got = network_knn.nearest_flows_on_network(o, d, edges, k, cutoff)
        assert rows(got, "ref", "rank", "nn", "distance") == rows(want, "ref", "rank", "nn", "distance")
    assert network_knn.nearest_flows_on_network(o.limit(0), d, edges, 3, 400).count() == 0


def test_grown_networks(spark):
    """Every cluster hangs together as far as the network does, and what is laid is as long as the least tree over its parts' distances at most."""
    rnd = random.Random(1)
    net = sorted({tuple(sorted(rnd.sample(range(60), 2))) for _ in range(95)})
    net = [(a, b, rnd.choice([1, 2, 2, 3, 7])) for a, b in net] + [(100, 101, 1), (101, 102, 1)]
    weight = {(a, b): w for a, b, w in net}
    own = [(c, *rnd.choice(net)[:2]) for c in range(6) for _ in range(4)] + [(7, 100, 101), (7, *net[0][:2]), (8, 101, 100), (8, 101, 102), (9, *net[3][:2]), (9, *net[3][:2]), (None, 1, 2), (9, None, 3)]
    edges = spark.createDataFrame(net + [(net[0][0], net[0][1], 50), (5, 5, 1)], "source long, target long, m int")
    got = {}
    for c, a, b in rows(network_growth.grown_networks(edges, spark.createDataFrame(own, "cluster long, source long, target long")), "cluster", "source", "target"):
        got.setdefault(c, set()).add((a, b))
    assert set(got) == {c for c, _, b in own if c is not None}

    def parts(pairs):
        groups = []
        for a, b in pairs:
            hit = [g for g in groups if a in g or b in g]
            groups = [g for g in groups if g not in hit] + [set().union({a, b}, *hit)]
        return groups

    for c, laid in got.items():
        mine = {tuple(sorted((a, b))) for x, a, b in own if x == c and a is not None}
        assert mine <= laid and all(e in weight for e in laid)
        whole = parts([(a, b) for a, b, _ in net])
        assert len(parts(laid)) == len({next(i for i, g in enumerate(whole) if a in g) for a, _ in mine})
        groups = parts(mine)
        far = sorted((min(_distances(net, x).get(y, 1e9) for x in p for y in q), i, j) for (i, p), (j, q) in itertools.combinations(enumerate(groups), 2))
        tree, name = 0, list(range(len(groups)))
        for d, i, j in far:
            if d < 1e9 and name[i] != name[j]:
                tree += d
                name = [name[i] if n == name[j] else n for n in name]
        assert sum(weight[e] for e in laid - mine) <= tree
    assert network_growth.grown_networks(edges, spark.createDataFrame([], "cluster long, source long, target long")).count() == 0


def test_crowded_edges(spark, monkeypatch):
    """Points of one edge meet in parts: the same pairs, with one table and with two."""
    rnd = random.Random(9)
    net = [(1, 1, 2, 50), (2, 2, 3, 30), (3, 3, 1, 40), (4, 3, 4, 20), (5, 8, 9, 10)]
    edges = spark.createDataFrame(net, "id long, source long, target long, m int")
    length = {e: m for e, _, _, m in net}
    on = [(i, e := (2 if i % 2 else rnd.choice(net)[0]), s := rnd.randrange(length[e] + 1), length[e] - s) for i in range(50)]
    points = network.with_nodes(spark.createDataFrame(on, "id long, edge_id long, dist_to_start int, dist_to_end int"), edges).persist()
    nodes = network.node_distances(edges, 100).persist()
    between = {(r.source, r.target): r.m for r in nodes.collect()}
    ends = {e: (a, b) for e, a, b, _ in net}

    def far(p, q):
        (_, e, s, t), (_, f, u, v) = p, q
        if e == f:
            return abs(s - u)
        ways = [between.get(k) for k in itertools.product(ends[e], ends[f])]
        return None if None in ways else min(w + x + y for w, (x, y) in zip(ways, itertools.product((s, t), (u, v)), strict=True))

    want = sorted((p[0], q[0], far(p, q)) for p in on for q in on if p[0] < q[0] and far(p, q) is not None)
    for hot in (4, 2048):
        monkeypatch.setattr(network, "HOT", hot)
        assert rows(network.point_distances(points, nodes), "i", "j", "d") == want
    got = rows(network.point_distances(points.filter("id < 9"), nodes, points), "i", "j", "d")
    assert got == sorted((p[0], q[0], far(p, q)) for p in on[:9] for q in on if p[0] != q[0] and far(p, q) is not None)
