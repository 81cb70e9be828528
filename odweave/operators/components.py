"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import attach
from ..plans.storage import forget, materialize

#: Edges of one partition that are joined in memory before the rounds begin.
CHUNK = 1 << 20


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) among these edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def _contract(batches: Iterator[pa.RecordBatch], names: tuple[str, str] = ("u", "v")) -> Iterator[pa.RecordBatch]:
    """Edges of a partition, chunk by chunk, as an edge from each node to the smallest that the chunk joins it to."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _joined(u, v)], names)

    for b in batches:
        held.append(b)
        if sum(len(x) for x in held) >= CHUNK:
            yield from out()
            held = []
    if held:
        yield from out()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", label: str = "components", small: int = 0) -> DataFrame:
    """(node, component): every end of an edge, with the smallest node of its weak component.

    Nodes are integers. Self loops make their node known; edges with a null end are left out; an empty
    edge table gives no rows. Partitions first join what they hold, so that dense graphs shrink to about
    a row for each node. Then each round replaces an edge by one to a smaller neighbour: large-star
    joins the larger neighbours of a node to the smallest, small-star the smaller ones, until nothing
    changes; that takes O(log^2 n) rounds whatever the diameter. Rounds are cut by written tables.
    small (at most CHUNK): where partitions leave no more rows than that, one task joins them and no rounds follow.
    """
    both = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).dropna()
    known = materialize(both.mapInArrow(_contract, "u long, v long").distinct(), f"{label}-nodes")
    if small and known.count() <= min(small, CHUNK):
        return known.coalesce(1).mapInArrow(lambda b: _contract(b, ("node", "component")), "node long, component long")
    now = known.filter("u <> v")
    print_of = _print_of(now)
    while print_of[0]:
        large = _star(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        mid = materialize(large, label)
        done = materialize(_star(mid, larger=False), label)
        forget(now, mid)
        now, last = done, print_of
        print_of = _print_of(now)
        if print_of == last:
            break
    roots = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return known.select(F.col("u").alias("node")).distinct().join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _print_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(e: DataFrame, larger: bool) -> DataFrame:
    """larger: joins v > u to the smallest of u and its neighbours; else v < u, and u itself. Edges point from larger to smaller."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    if larger:
        near = attach(e.filter("v > u"), least, "u", "n", F.xxhash64("v"))
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        near = attach(e, least, "u", "n", F.xxhash64("v"))
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()
