"""Sums over all pairs of points without a table of pairs: blocks of points meet as matrices inside tasks.

Points are dealt into blocks of bounded size, a block is one row, and blocks meet by an equi-join. Each task turns
two blocks into a matrix of distances and gives back one figure for each point and cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import ordered_index
from ..plans.storage import materialize, parallelism

#: Points of a block.
BLOCK = 1024
Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _hyp(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(x * x + y * y)


def _ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = [np.ascontiguousarray(a[:, i])[:, None] - np.ascontiguousarray(b[:, i])[None, :] for i in range(4)]
    return _hyp(d[0], d[1]), _hyp(d[2], d[3])


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of flows (ox, oy, dx, dy): that of the origins and that of the destinations, each half-even in whole numbers, added."""
    o, d = _ends(a, b)
    return np.rint(o) + np.rint(d)


def chebyshev(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    o, d = _ends(a, b)
    return np.maximum(np.rint(o), np.rint(d))


def manhattan_exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    o, d = _ends(a, b)
    return o + d


def euclid4d(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    o, d = _ends(a, b)
    return np.rint(np.sqrt(o * o + d * d))


def _length(f: np.ndarray) -> np.ndarray:
    return _hyp(f[:, 0] - f[:, 2], f[:, 1] - f[:, 3])


def length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.rint(np.abs(_length(a)[:, None] - _length(b)[None, :]))


def _by_lengths(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x over the product of both lengths; NaN where that is 0."""
    both = _length(a)[:, None] * _length(b)[None, :]
    return x / np.where(both == 0, np.nan, both)


def direction(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    way = lambda f: (f[:, 2] - f[:, 0], f[:, 3] - f[:, 1])
    (ax, ay), (bx, by) = way(a), way(b)
    return 1.0 - _by_lengths(ax[:, None] * bx[None, :] + ay[:, None] * by[None, :], a, b)


def euclid4d_norm(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    o, d = _ends(a, b)
    return np.sqrt(_by_lengths(o * o + d * d, a, b))


#: The measures of distance.measures() on blocks of flows; those in WHOLE give whole numbers. NaN stands for null.
MEASURES: dict[str, Measure] = {"manhattan": manhattan, "manhattan_exact": manhattan_exact, "chebyshev": chebyshev, "euclid4d": euclid4d, "length": length, "direction": direction, "euclid4d_norm": euclid4d_norm}
WHOLE = {"manhattan", "chebyshev", "euclid4d", "length"}


def euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance over any columns."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        x = a[:, i, None] - b[None, :, i]
        out += x * x
    return np.sqrt(out)


def _parts(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Far, turn and grow of flows: the three parts of the geometric distance, before they are scaled."""
    angle = lambda f: (lambda t: np.where(t < 0, t + 360, t))(np.degrees(np.arctan2(f[:, 3] - f[:, 1], f[:, 2] - f[:, 0])))
    gap = lambda x, y: np.abs(x[:, None] - y[None, :])
    return [manhattan(a, b), gap(angle(a), angle(b)), gap(_length(a), _length(b))]


def _met(points: DataFrame, key: str, columns: list[str], label: str, block: int) -> DataFrame:
    """Each two blocks (and each block with itself) as one row: ids, labels and columns of both."""
    p = points.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("c"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v")).dropna()
    n = max(1, min(SPLIT, -(-p.count() // block)))
    dealt = p.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("b")).agg(F.collect_list("id").alias("id"), F.collect_list("c").alias("c"), F.flatten(F.collect_list("v")).alias("v"))
    rows = materialize(dealt, "blocks")
    other = rows.select(F.col("b").alias("b2"), F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("v").alias("v2"))
    wide = rows.withColumn("b2", F.explode(F.sequence(F.col("b"), F.lit(n - 1))))
    return wide.join(other, "b2").repartition(min(n * n, parallelism(points.sparkSession, 4)), "b", "b2")


def _matrices(pdf: pd.DataFrame, width: int) -> Iterator[tuple]:
    for r in pdf.itertuples(index=False):
        yield np.asarray(r.id), np.asarray(r.c), np.asarray(r.v).reshape(-1, width), np.asarray(r.id2), np.asarray(r.c2), np.asarray(r.v2).reshape(-1, width), r.b == r.b2


#: Blocks that pair_blocks() makes, and rows and columns of the matrices that a task works on.
SPLIT, TILE = 32, (256, 2048)


def pair_blocks(points: DataFrame, key: str, columns: list[str], label: str | None = None, split: int = SPLIT) -> DataFrame:
    """Each two blocks (b <= b2) of points in the order of key as one row, with ids, labels and columns of both. Rows with a null go.

    Blocks grow with the points and their number doesn't, so what is shuffled is a multiple of the points and not of
    their pairs. A task reads its pairs of blocks one after another.
    """
    c = F.lit(0) if label is None else F.col(label)
    p = points.select(F.col(key).cast("long").alias("id"), c.cast("long").alias("c"), *[F.col(x).cast("double").alias(f"_v{i}") for i, x in enumerate(columns)]).dropna()
    placed = ordered_index(p, [F.col("id")], "_x", "pair-points")
    size = max(1, -(-placed.count() // split))
    dealt = placed.groupBy(F.floor(F.col("_x") / size).cast("int").alias("b")).agg(F.collect_list(F.struct("id", "c", F.array(*[f"_v{i}" for i in range(len(columns))]).alias("v"))).alias("r"))
    rows = materialize(dealt.select("b", F.col("r.id").alias("id"), F.col("r.c").alias("c"), F.flatten("r.v").alias("v")), "pair-blocks")
    other = rows.select(F.col("b").alias("b2"), F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("v").alias("v2"))
    wide = rows.withColumn("b2", F.explode(F.sequence(F.col("b"), F.lit(split - 1))))
    return wide.join(other.hint("shuffle_hash"), "b2").repartition(min(split * (split + 1) // 2, parallelism(points.sparkSession, 4)))


Side = tuple[np.ndarray, np.ndarray, np.ndarray]


def _tiles(pdf: pd.DataFrame, width: int) -> Iterator[tuple[Side, Iterator[tuple[Side, np.ndarray | None]]]]:
    """Parts of the first block of each row, each with the parts of the second: ids, labels and columns, and which pairs have id < id (None: all)."""
    for r in pdf.itertuples(index=False):
        one, two = ([np.asarray(i), np.asarray(c), np.asarray(v).reshape(-1, width)] for i, c, v in ((r.id, r.c, r.v), (r.id2, r.c2, r.v2)))
        one, two = ([x[o] for x in side] for side, o in ((one, np.argsort(one[0], kind="stable")), (two, np.argsort(two[0], kind="stable"))))

        def against(own: np.ndarray, two: list[np.ndarray] = two) -> Iterator[tuple[Side, np.ndarray | None]]:
            for at in range(0, len(two[0]), TILE[1]):
                far = tuple(x[at : at + TILE[1]] for x in two)
                if own[0] < far[0][-1]:
                    yield far, None if own[-1] < far[0][0] else own[:, None] < far[0][None, :]

        for at in range(0, len(one[0]), TILE[0]):
            part = tuple(x[at : at + TILE[0]] for x in one)
            yield part, against(part[0])


def pair_summary(points: DataFrame, key: str, columns: list[str], measure: Measure, whole: bool = False, split: int = SPLIT) -> DataFrame:
    """(i, n, sum_d, min_d, max_d) over the pairs i < j of each i, without a table of pairs. Distances of NaN count as null. whole: they are whole numbers."""
    width = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (own, _, va), others in _tiles(pdf, width):
                n, total, low, high, met = np.zeros(len(own), np.int64), np.zeros(len(own)), np.full(len(own), np.inf), np.full(len(own), -np.inf), np.zeros(len(own), bool)
                for (far, _, vb), keep in others:
                    d = measure(va, vb)
                    if keep is not None:
                        met |= keep.any(axis=1)
                        d = np.where(keep, d, np.nan)
                    else:
                        met[:] = True
                    s = d.sum(axis=1)
                    if np.isnan(s).any():
                        on = ~np.isnan(d)
                        n += on.sum(axis=1)
                        total += d.sum(axis=1, where=on)
                        low, high = np.minimum(low, d.min(axis=1, where=on, initial=np.inf)), np.maximum(high, d.max(axis=1, where=on, initial=-np.inf))
                    else:
                        n += len(far)
                        total += s
                        low, high = np.minimum(low, d.min(axis=1)), np.maximum(high, d.max(axis=1))
                got = n > 0
                yield pd.DataFrame({"i": own, "n": n, "sum_d": pd.arrays.FloatingArray(total, ~got), "min_d": pd.arrays.FloatingArray(low, ~got), "max_d": pd.arrays.FloatingArray(high, ~got)})[met]

    found = pair_blocks(points, key, columns, split=split).mapInPandas(run, "i long, n long, sum_d double, min_d double, max_d double")
    out = found.groupBy("i").agg(F.sum("n").alias("n"), F.sum("sum_d").alias("sum_d"), F.min("min_d").alias("min_d"), F.max("max_d").alias("max_d"))
    return out.withColumns({"sum_d": F.col("sum_d").cast("long"), "min_d": F.col("min_d").cast("int"), "max_d": F.col("max_d").cast("int")}) if whole else out


def pair_histogram(points: DataFrame, key: str, columns: list[str], measure: Measure, bins: int = 20, split: int = SPLIT) -> DataFrame:
    """V9: (bin, n) of the distances of all pairs, scaled to [0, 1] by their least and greatest, each pair once."""
    ends = pair_summary(points, key, columns, measure, split=split).agg(F.min("min_d"), F.max("max_d")).first()
    low, span, width = ends[0] or 0.0, (ends[1] or 0.0) - (ends[0] or 0.0), len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(bins + 1, np.int64)
        for pdf in batches:
            for (_, _, va), others in _tiles(pdf, width):
                for (_, _, vb), keep in others:
                    d = measure(va, vb)
                    d = d.ravel() if keep is None else d[keep]
                    at = np.full(len(d), float(bins)) if span == 0 else np.minimum(np.floor((d - low) / span * bins), bins - 1)
                    counts += np.bincount(np.where(np.isnan(at), bins, at).astype(int), minlength=bins + 1)
        yield pd.DataFrame({"bin": pd.array([*range(bins), None], "Int32"), "n": counts})[counts > 0]

    return pair_blocks(points, key, columns, split=split).mapInPandas(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))


def cluster_ends(points: DataFrame, key: str, columns: list[str], label: str, measure: Measure, split: int = SPLIT) -> DataFrame:
    """(sep, diam): the least distance of two points of unlike clusters and the greatest of two of the same, one row."""
    width = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sep, diam = np.inf, -np.inf
        for pdf in batches:
            for (_, ca, va), others in _tiles(pdf, width):
                for (_, cb, vb), keep in others:
                    d, same = measure(va, vb), ca[:, None] == cb[None, :]
                    on = ~np.isnan(d) if keep is None else keep & ~np.isnan(d)
                    sep, diam = min(sep, d.min(where=on & ~same, initial=np.inf)), max(diam, d.max(where=on & same, initial=-np.inf))
        yield pd.DataFrame({"sep": pd.array([sep if np.isfinite(sep) else None], "Float64"), "diam": pd.array([diam if np.isfinite(diam) else None], "Float64")})

    met = pair_blocks(points, key, columns, label, split)
    return met.mapInPandas(run, "sep double, diam double").agg(F.min("sep").alias("sep"), F.max("diam").alias("diam"))


def cluster_sums(points: DataFrame, key: str, columns: list[str], label: str, measure: Measure, block: int = BLOCK) -> DataFrame:
    """(id, c, cj, total): the sum of the distances of each point, of cluster c, to all others of each cluster cj. Rows with a null go."""
    width = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ia, ca, va, ib, cb, vb, same in _matrices(pdf, width):
                (kinds_a, at_a), (kinds_b, at_b) = (np.unique(c, return_inverse=True) for c in (ca, cb))
                hot_a, hot_b = np.eye(len(kinds_a))[at_a], np.eye(len(kinds_b))[at_b]
                sums_a, sums_b = np.zeros((len(ia), len(kinds_b))), np.zeros((len(ib), len(kinds_a)))
                for x in range(0, len(ia), TILE[0]):
                    for y in range(0, len(ib), TILE[1]):
                        d = measure(va[x : x + TILE[0]], vb[y : y + TILE[1]])
                        if same:
                            own = np.arange(max(x, y), min(x + d.shape[0], y + d.shape[1]))
                            d[own - x, own - y] = 0.0
                        else:
                            sums_b[y : y + TILE[1]] += d.T @ hot_a[x : x + TILE[0]]
                        sums_a[x : x + TILE[0]] += d @ hot_b[y : y + TILE[1]]
                for own, c, kinds, sums in ((ia, ca, kinds_b, sums_a), (ib, cb, kinds_a, sums_b))[: 1 if same else 2]:
                    yield pd.DataFrame({"id": np.repeat(own, len(kinds)), "c": np.repeat(c, len(kinds)), "cj": np.tile(kinds, len(own)), "total": sums.ravel()})

    met = _met(points, key, columns, label, block)
    return met.mapInPandas(run, "id long, c long, cj long, total double").groupBy("id", "c", "cj").agg(F.sum("total").alias("total"))


def silhouette(points: DataFrame, key: str, columns: list[str], label: str, measure: Measure = manhattan, drop_noise: bool = True, block: int = BLOCK) -> DataFrame:
    """V1: (id, cluster, sil) of points(key, columns, label), without a table of pairs. A cluster of one point has 0; no rows for fewer than two clusters. Noise (0) is left out, or is a cluster like others."""
    p = points.filter(F.col(label) != 0) if drop_noise else points
    p = materialize(p.select(key, *[c for c in columns if c not in (key, label)], label).dropna(), "sil-points")
    size = p.groupBy(F.col(label).cast("long").alias("cj")).agg(F.count("*").alias("n"))
    per = cluster_sums(p, key, columns, label, measure, block).join(size, "cj")
    own = F.col("c") == F.col("cj")
    w = per.groupBy("id", "c").agg(F.max(F.when(own, F.col("n"))).alias("n"), F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"))
    sil = F.when(F.col("n") == 1, F.lit(0.0)).when(F.greatest("a", "b") == 0, F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return w.filter("b IS NOT NULL AND NOT isnan(b)").select("id", F.col("c").alias("cluster"), sil.alias("sil"))


def geometric(flows: DataFrame, key: str, columns: list[str], block: int = BLOCK) -> Measure:
    """D15 as a measure: far, turn and grow scaled to [0, 1] by their least and greatest value over all pairs of these flows, and added."""
    width = len(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.full(3, np.inf), np.full(3, -np.inf)
        for pdf in batches:
            for (_, _, va), others in _tiles(pdf, width):
                for (_, _, vb), keep in others:
                    for i, d in enumerate(_parts(va, vb)):
                        d = d if keep is None else d[keep]
                        if d.size:
                            low[i], high[i] = min(low[i], d.min()), max(high[i], d.max())
        if (low <= high).all():
            yield pd.DataFrame({"part": range(3), "low": low, "high": high})

    met = pair_blocks(flows, key, columns)
    ends = met.mapInPandas(run, "part int, low double, high double").groupBy("part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = {r.part: (r.low, r.high) for r in ends.collect()}  # three rows
    (l0, s0), (l1, s1), (l2, s2) = ((a, (b - a) or np.nan) for a, b in (found.get(i, (0.0, 1.0)) for i in range(3)))

    def scaled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        far, turn, grow = _parts(a, b)
        return (far - l0) / s0 + (turn - l1) / s1 + (grow - l2) / s2

    return scaled
