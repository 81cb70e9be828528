"""Near-duplicate embeddings by NN-descent, with exact links and components.

1. Equal vectors become one class; vectors that cannot link are set aside.
2. Classes that lie within half the linking angle of a leader form a ball: all its members link with
   each other, without any pair being listed. Leaders are found in windows of cross-polytope order,
   again and again while balls still merge; so a large group of copies shrinks to a few balls.
3. NN-descent over the leaders: neighbour lists start from windows of several cross-polytope orders,
   more of them the more leaders there are, and are refined by comparing the neighbours of each node with
   each other. A list that holds links only is saturated and grows.
4. The recall of links is audited twice: for a sample of nodes against all nodes, which counts the links that
   the table has, and by vectors planted at the very threshold beside a sample of leaders, which go through
   orders and descent with the rest; so recall is measured whether or not the table has links. While too few
   are known, fresh orders are added and another descent follows; after TRIES of that, or where nothing could
   be planted, all leaders are compared with all, block by block, which loses nothing.
5. Pairs of balls are settled in double precision: all linked, none linked, or, in between, by blocks of members.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..plans.skew import attach
from ..plans.storage import forget, materialize, parallelism

THRESHOLD = 0.9
#: Neighbours in a list that isn't saturated; rows of a window; neighbours compared with each other at a time.
LIST, WINDOW, BLOCK = 10, 256, 64
#: The orders that fill lists (all orders give links), and the share of links that orders alone may miss.
FILLING, MISS = 2, 0.002
#: Rounds of NN-descent; nodes audited and links planted (fixed numbers, not shares); fresh orders after a failed audit; the recall that audits must show; tries.
ROUNDS, AUDITED, PLANTED, FRESH, RECALL, TRIES = 2, 4096, 2048, 4, 0.995, 3
#: Directions and symbols of an order's code. Wider vectors are projected to as many dimensions first.
DIMENSIONS, SYMBOLS = 64, 3
#: Similarities in the graph are of half-precision vectors; this is more than they can be off.
SLACK = 4e-3
#: Members of a ball that are compared as one matrix; leaders in a block of the exact way.
MEMBERS, EXACT = 256, 8192
_SEED = 29


def _matrix(col: pa.Array) -> list[np.ndarray] | np.ndarray:
    """Rows of a list column, as one matrix if they are of one length."""
    flat, ends = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    n = np.diff(ends)
    if len(n) and (n == n[0]).all():
        return flat.reshape(len(n), n[0])
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def unit_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(uid, key, same, unit): unit is null for vectors that link with nothing; `same` is equal for equal vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            flat = col.flatten().to_numpy(zero_copy_only=False)  # without what null lists hold; null components become NaN
            dims = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
            starts = np.cumsum(dims) - dims
            same, unit = np.full(len(dims), None), np.full(len(dims), None)
            for d in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == d)
                x = flat[starts[at][:, None] + np.arange(d)] + 0.0  # -0.0 equals 0.0
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                at, x = at[good], x[good]
                same[at] = [xxhash.xxh3_128_hexdigest(r.tobytes(), _SEED) for r in x]
                x = x / np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                for i, r in zip(at, x, strict=True):
                    unit[i] = r
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.string()), pa.array(unit, pa.list_(pa.float64()))], ["uid", "key", "same", "unit"])

    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, T.StructType([rows.schema["uid"], rows.schema["key"], T.StructField("same", T.StringType()), T.StructField("unit", T.ArrayType(T.DoubleType()))]))


def orders_for(n: int, miss: float = MISS) -> int:
    """Orders of n leaders after which a pair at the threshold has been in no window with a probability of about `miss`.

    An order puts a pair of cosine 0.9 among random vectors into one window with a probability of at least
    0.46 for 24,000 vectors, 0.3 for 120,000 and 0.24 for 400,000 (measured); it falls as n to the power 0.22.
    """
    one = min(0.75, 0.43 * (max(1, n) / 24_000) ** -0.22)
    return max(4, math.ceil(math.log(miss) / math.log(1 - one)))


def _codes(vectors: DataFrame, orders: range, cols: list[str]) -> DataFrame:
    """vectors(unit) with codes (by order of the range, the directions that lie nearest, one after the other), dim and half (the vector in half precision)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            rows = _matrix(b.column(b.num_columns - 1))
            dims = np.array([len(r) for r in rows])
            codes = np.zeros((len(dims), len(orders)), np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([rows[i] for i in at]).astype(np.float32)
                m = min(int(d), DIMENSIONS)
                for k, t in enumerate(orders):
                    if (d, t) not in turns:
                        rng = np.random.default_rng([_SEED, t, int(d)])
                        turns[d, t] = np.concatenate([np.linalg.qr(rng.standard_normal((int(d), m)))[0] for _ in range(SYMBOLS)], axis=1).astype(np.float32)
                    y = (x @ turns[d, t]).reshape(len(at), SYMBOLS, m)
                    best = np.abs(y).argmax(2)
                    sign = np.take_along_axis(y, best[:, :, None], 2)[:, :, 0] > 0
                    symbol = best * 2 + sign
                    for s in range(SYMBOLS):
                        codes[at, k] = codes[at, k] * (2 * DIMENSIONS) + symbol[:, s]
            half = [np.asarray(r, np.float16).tobytes() for r in rows]
            code = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, len(orders)), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(dims, pa.int32()), pa.array(half, pa.binary()), code], [*cols, "dim", "half", "codes"])

    kinds = dict(vectors.dtypes)
    return vectors.select(*cols, "unit").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in cols) + ", dim int, half binary, codes array<long>")


def _ordered(points: DataFrame, orders: range, cols: list[str]) -> DataFrame:
    """points(bid, dim, codes, and cols) once for each of the range of their codes, range-partitioned and sorted by it."""
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("codes")[t].alias("code")) for t in orders])).alias("o")
    rows = points.select(each, "dim", "bid", *cols).select("o.t", "dim", "o.code", "bid", *cols)
    return rows.repartitionByRange(parallelism(points.sparkSession), "t", "dim", "code", "bid").sortWithinPartitions("t", "dim", "code", "bid")


def _windows(window: int, overlap: bool, column: str, work: Callable) -> Callable:
    """A mapInArrow function that hands `work` windows of consecutive rows of one order and dimension: (columns by name, matrix)."""

    def stacked(col: pa.Array) -> np.ndarray:
        if pa.types.is_binary(col.type):
            return np.frombuffer(b"".join(col.to_pylist()), np.float16).reshape(len(col), -1).astype(np.float32)
        return np.stack(_matrix(col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        fresh = True

        def cut(t: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, fresh
            same = t.column("t").to_numpy().astype(np.int64) << 32 | t.column("dim").to_numpy()
            ends = [*(np.flatnonzero(np.diff(same)) + 1).tolist(), len(same)]
            at = 0
            for e in ends:
                final = last or e < len(same)
                while e - at >= window or (final and e > at and (fresh or e - at > (window // 2 if overlap else 0))):
                    w = t.slice(at, min(window, e - at))
                    out = work({c: w.column(c).to_numpy() for c in w.column_names if c != column}, stacked(w.column(column).combine_chunks()))
                    if out is not None:
                        yield out
                    fresh = False
                    at += window // 2 if overlap and (e - at > window or not final) else len(w)
                if final:
                    at, fresh = e, True
            held = t.slice(at)

        for b in batches:
            t = pa.Table.from_batches([b])
            yield from cut(t if held is None or not held.num_rows else pa.concat_tables([held, t]).combine_chunks(), False)
        if held is not None and held.num_rows:
            yield from cut(held, True)

    return run


def _merges(balls: DataFrame, half: float, turn: int) -> DataFrame:
    """(old, new, radius, n) of balls that go into another one whose leader is within reach of all their members, by windows of one order; radius bounds how far they then are."""
    near = math.cos(half)

    def work(c: dict[str, np.ndarray], x: np.ndarray) -> pa.RecordBatch | None:
        sim = x @ x.T
        if (sim >= near).sum() <= len(x):
            return None
        reach = np.arccos(np.clip(sim, -1, 1)) + c["radius"][None, :]
        free, old, new = np.ones(len(x), bool), [], []
        for i in np.lexsort((c["bid"], -c["n"])):
            if not free[i]:
                continue
            free[i] = False
            got = np.flatnonzero(free & (reach[i] <= half))
            free[got] = False
            old += got.tolist()
            new += [i] * len(got)
        if not old:
            return None
        cols = c["bid"][old], c["bid"][new], reach[new, old].astype(float), c["n"][old]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["old", "new", "radius", "n"])

    return _ordered(balls, range(turn, turn + 1), ["radius", "n", "unit"]).mapInArrow(_windows(WINDOW, False, "unit", work), "old long, new long, radius double, n long")


def _balls(points: DataFrame, n: int, half: float) -> DataFrame:
    """(cid, bid) of points(cid, unit, dim, codes): the class whose ball they are in. Merging goes on while it takes away more than one ball in 200."""
    balls = points.select(F.col("cid").alias("bid"), "dim", "codes", F.col("unit").cast("array<float>").alias("unit"), F.lit(0.0).alias("radius"), F.lit(1).cast("long").alias("n"))
    passes: list[DataFrame] = []
    for turn in range(12):
        moves = materialize(_merges(balls, half, turn % 4), "embed-moves")
        gone = moves.count()
        if gone:
            passes.append(moves)
        n -= gone
        if gone * 200 <= n:
            break
        into = moves.groupBy(F.col("new").alias("bid")).agg(F.max("radius").alias("r"), F.sum("n").alias("more"))
        stay = balls.join(moves.select(F.col("old").alias("bid")), "bid", "left_anti").join(into, "bid", "left")
        stay = stay.select("bid", "dim", "codes", "unit", F.greatest("radius", F.coalesce("r", F.lit(0.0))).alias("radius"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        balls = materialize(stay, "embed-merged")
    # From the last pass back: where a ball went is known for all its later goals, of each of which a pass names one window's balls at most.
    goal = None
    for moves in reversed(passes):
        step = moves.select("old", "new")
        if goal is not None:
            step = step.join(goal.select(F.col("old").alias("new"), F.col("new").alias("end")), "new", "left").select("old", F.coalesce("end", "new").alias("new")).unionByName(goal)
        goal = step
    if goal is None:
        return points.select("cid", F.col("cid").alias("bid"))
    return points.select("cid").join(goal.select(F.col("old").alias("cid"), "new"), "cid", "left").select("cid", F.coalesce("new", "cid").alias("bid"))


@F.pandas_udf(T.DoubleType())
def _dot(a: pd.Series, b: pd.Series) -> pd.Series:
    """Products of vectors that are of one length in each row."""
    if len({len(x) for x in a}) == 1:
        return pd.Series(np.einsum("ij,ij->i", np.stack(a), np.stack(b)))
    return pd.Series([float(x @ y) for x, y in zip(a, b, strict=True)], dtype=float)


def _with_angle(pairs: DataFrame, classes: DataFrame, left: str, right: str) -> DataFrame:
    """pairs with cos and angle (in double precision) of the classes that two columns name."""
    units = classes.select(F.col("cid").alias("_c"), "unit")
    for c, unit in ((left, "_u"), (right, "_w")):
        pairs = pairs.join(units, F.col(c) == F.col("_c")).drop("_c").withColumnRenamed("unit", unit)
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _dot(F.col("_u"), F.col("_w"))))
    return pairs.withColumn("cos", cos).withColumn("angle", F.acos("cos")).drop("_u", "_w")


_EDGE = "v long, n long, sim float, lim float"


def _edges(v: np.ndarray, n: np.ndarray, sim: np.ndarray, lim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.array(sim, pa.float32()), pa.array(lim, pa.float32())], ["v", "n", "sim", "lim"])


def _limits(link: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least half-precision similarities at which members of balls of these radii may link: cos(link + a + b), as a product of two columns by two rows.

    Radii are at most about half of link, so the sums stay below pi.
    """
    left = np.stack([np.cos(link + a), -np.sin(link + a)], axis=1).astype(np.float32)
    return left @ np.stack([np.cos(b), np.sin(b)]).astype(np.float32) - np.float32(SLACK)


def _from_windows(balls: DataFrame, link: float, size: int, orders: range, filling: int) -> DataFrame:
    """Edges from windows of the orders of a range of codes: all links, and from the first `filling` also the nearest `size` of a window."""
    fill = set(orders[:filling])

    def work(c: dict[str, np.ndarray], x: np.ndarray) -> pa.RecordBatch | None:
        if len(x) < 2:
            return None
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        lim = _limits(link, c["radius"], c["radius"])
        good = sim >= lim
        if c["t"][0] in fill:
            good |= sim >= np.partition(sim, max(0, len(x) - size), axis=1)[:, max(0, len(x) - size), None]
        i, j = np.nonzero(good & (sim > -2))
        return _edges(c["bid"][i], c["bid"][j], sim[i, j], lim[i, j]) if len(i) else None

    return _ordered(balls, orders, ["radius", "half"]).mapInArrow(_windows(WINDOW, True, "half", work), _EDGE)


def _lists(edges: DataFrame, size: int) -> DataFrame:
    """(v, near): links of each node first, then the nearest: `size` of them; if those are links only, all links and `size` more."""
    best = edges.filter("v <> n").groupBy("v", "n").agg(F.max("sim").alias("sim"), F.max("lim").alias("lim"))
    # Links come first: that of a large ball may be less similar than a neighbour that is none.
    rows = best.groupBy("v").agg(F.sort_array(F.collect_list(F.struct((F.col("sim") >= F.col("lim")).alias("link"), "sim", "n", "lim")), asc=False).alias("near"))
    links = F.size(F.filter("near", lambda e: e["link"]))
    return rows.select("v", F.slice("near", F.lit(1), F.when(links >= size, links + size).otherwise(F.lit(size))).alias("near"))


def _listed(lists: DataFrame) -> DataFrame:
    return lists.select("v", F.explode("near").alias("e")).select("v", "e.n", "e.sim", "e.lim")


def _descend(lists: DataFrame, balls: DataFrame, link: float, turn: int) -> DataFrame:
    """Edges of one NN-descent round: neighbours of a node, either way, are compared with each other.

    A node with more than BLOCK neighbours deals them into blocks, other ones in each round, and compares
    within blocks; so a hub costs as much as its neighbours are many, and no task holds all of them.
    """
    e = _listed(lists).select("v", "n")
    both = materialize(e.unionByName(e.select(F.col("n").alias("v"), F.col("v").alias("n"))).distinct(), "embed-both")
    blocks = both.groupBy("v").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    dealt = both.join(blocks, "v").select("v", "n", F.pmod(F.xxhash64("n", F.lit(turn)), F.col("k")).alias("k"))
    floor = lists.select(F.col("v").alias("n"), F.array_min("near.sim").alias("floor"))
    known = balls.select(F.col("bid").alias("n"), "half", F.col("radius").cast("float").alias("radius")).join(floor, "n", "left")
    sent = dealt.join(known, "n")
    one = F.struct("n", "half", "radius", F.coalesce("floor", F.lit(-1.0).cast("float")).alias("floor"))
    sets = sent.groupBy("v", "k").agg(F.collect_list(one).alias("s")).select("s")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(0)
            rows, ends = col.flatten(), col.offsets.to_numpy()
            ends = ends - ends[0]
            ids, radius, low = (rows.field(k).to_numpy(zero_copy_only=False) for k in ("n", "radius", "floor"))
            raw = rows.field("half").to_pylist()
            out = []
            for a, z in zip(ends[:-1], ends[1:], strict=True):
                if z - a < 2 or len({len(r) for r in raw[a:z]}) != 1:
                    continue
                x = np.frombuffer(b"".join(raw[a:z]), np.float16).reshape(z - a, -1).astype(np.float32)
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                lim = _limits(link, radius[a:z], radius[a:z])
                i, j = np.nonzero(((sim > low[a:z][:, None]) | (sim >= lim)) & (sim > -2))
                out.append((ids[a:z][i], ids[a:z][j], sim[i, j], lim[i, j]))
            if out:
                yield _edges(*[np.concatenate([o[k] for o in out]) for k in range(4)])

    return sets.mapInArrow(compare, _EDGE)


def _against_all(balls: DataFrame, picked: DataFrame, link: float) -> DataFrame:
    """Links (v, n, sim, lim) of the picked nodes, which are gathered and sent, with all nodes."""
    queries: dict[int, list] = {}
    for r in picked.select("bid", "half", "radius").collect():
        queries.setdefault(len(r.half), []).append((r.bid, bytes(r.half), r.radius))
    sent = balls.sparkSession.sparkContext.broadcast({d: (np.array([x[0] for x in q]), b"".join(x[1] for x in q), np.array([x[2] for x in q])) for d, q in queries.items()})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, radius, raw = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(1).to_pylist()
            size = np.array([len(x) for x in raw])
            for d, (q, bits, r) in sent.value.items():
                u = np.frombuffer(bits, np.float16).reshape(len(q), -1).astype(np.float32)
                at = np.flatnonzero(size == d)
                for a in range(0, len(at), 1024):
                    own = at[a : a + 1024]
                    x = np.frombuffer(b"".join(raw[k] for k in own), np.float16).reshape(len(own), -1).astype(np.float32)
                    for s in range(0, len(q), 1024):
                        sim, lim = u[s : s + 1024] @ x.T, _limits(link, r[s : s + 1024], radius[own])
                        i, j = np.nonzero(sim >= lim)
                        if len(i):
                            yield _edges(q[s : s + 1024][i], ids[own][j], sim[i, j], lim[i, j])

    return balls.select("bid", "half", "radius").mapInArrow(compare, _EDGE).filter("v <> n")


def _known(links: DataFrame, lists: DataFrame) -> tuple[int, int]:
    """(links, those of them that the lists hold); a link counts once."""
    pair = lambda df: df.select(F.least("v", "n").alias("v"), F.greatest("v", "n").alias("n")).distinct()
    have = pair(_listed(lists).filter("sim >= lim")).withColumn("ok", F.lit(1))
    n, ok = pair(links).join(have, ["v", "n"], "left").agg(F.count("*"), F.sum("ok")).first()
    return n, ok or 0


def _plants(balls: DataFrame, units: DataFrame, link: float, planted: int) -> DataFrame:
    """(bid, unit) of vectors at the linking angle from `planted` leaders by hash, in directions drawn for each; their ids are below zero, -1 less the leader's. Vectors of one dimension have none at that angle."""
    picked = balls.filter("dim > 1").select("bid").orderBy(F.xxhash64("bid", F.lit(_SEED + 1)), "bid").limit(planted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for bid, x in zip(pdf["bid"], pdf["unit"], strict=True):
                y = np.random.default_rng([_SEED, bid]).standard_normal(len(x))
                y -= (y @ x) * x
                out.append(math.cos(link - 1e-9) * x + math.sin(link - 1e-9) * y / np.sqrt(y @ y))
            yield pd.DataFrame({"bid": -1 - pdf["bid"], "unit": out})

    return picked.join(units, "bid").select("bid", "unit").mapInPandas(run, "bid long, unit array<double>")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, size: int = LIST, miss: float = MISS, audited: int = AUDITED, planted: int = PLANTED, recall: float = RECALL, tries: int = TRIES) -> DataFrame:
    """One row per vector: key, n_links (other vectors of cosine >= threshold), component_id (smallest key reachable) and kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths with each other; equal vectors link. Rows are told apart even if they
    repeat a key; a null key counts as a vector but names no component. An empty table gives no rows;
    other columns are ignored. Needs threshold >= 0.5. The result's attribute `audit` lists, for each audit, how many
    links were checked and how many of them the graph held: links of a sample of nodes (none where they have
    none), then planted ones. Where none could be planted, recall isn't measured and the exact way runs.
    """
    link = math.acos(threshold)
    half = link / 2 - 1e-4
    rows = materialize(unit_vectors(vectors, key, vector), "embed-units")
    grouped = rows.filter(F.col("unit").isNotNull()).groupBy("same").agg(F.count("*").alias("mult"), F.min("key").alias("first"), F.any_value("unit").alias("unit"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "embed-classes")
    n = classes.count()
    orders = orders_for(n, miss)
    coded = materialize(_codes(classes, range(orders), ["cid"]), "embed-codes")

    members = materialize(_balls(coded.join(classes.select("cid", "unit"), "cid"), n, half), "embed-members")
    # A leader's members are few enough for one task only by chance, so the leaders' vectors are joined as hot keys are.
    sizes = members.groupBy("bid").agg(F.count("*").alias("n"))
    leaders = sizes.join(classes.select(F.col("cid").alias("bid"), F.col("unit").alias("_w")), "bid")
    placed = attach(members, leaders, "bid", "n", F.col("cid")).join(classes.select("cid", "mult", "unit"), "cid")
    angle = F.when(F.col("cid") == F.col("bid"), 0.0).otherwise(F.acos(F.least(F.lit(1.0), _dot(F.col("unit"), F.col("_w")))))
    member = materialize(placed.select("cid", "bid", "mult", angle.alias("angle")), "embed-member")
    radii = member.groupBy("bid").agg(F.max("angle").alias("radius"), F.sum("mult").alias("weight"), F.count("*").alias("n"))
    balls = materialize(radii.join(coded.withColumnRenamed("cid", "bid"), "bid"), "embed-balls")

    links, audit = _neighbour_graph(balls, classes, link, size, orders, audited, planted, recall, tries)
    out = _settle(rows, classes, member, balls, links, threshold, link, key)
    out.audit = audit
    return out


def _neighbour_graph(balls: DataFrame, classes: DataFrame, link: float, size: int, orders: int, audited: int, planted: int, recall: float, tries: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Edges (v, n, sim, lim) that hold the links between balls, and the audits' counts of links checked and known."""
    units = classes.select(F.col("cid").alias("bid"), "unit")
    plants = materialize(_plants(balls, units, link, planted), "embed-plants")
    beside = plants.select("bid", F.expr("-1 - bid").alias("n"))
    single = _codes(plants, range(orders), ["bid"]).select("bid", F.lit(0.0).alias("radius"), "dim", "half", "codes")
    nodes = balls.select("bid", "radius", "dim", "half", "codes").unionByName(materialize(single, "embed-planted"))
    real = lambda edges: edges.filter("v >= 0 AND n >= 0")
    lists = materialize(_lists(_from_windows(nodes, link, size, range(orders), FILLING), size), "embed-lists")
    audit: list[tuple[int, int]] = []
    for i in range(tries):
        if i > 0:  # what the last audit found, and what fresh orders find
            again = nodes.select("bid", "radius").join(units.unionByName(plants), "bid")
            anew = materialize(_codes(again, range(orders + FRESH * (i - 1), orders + FRESH * i), ["bid", "radius"]), "embed-codes")
            more = _listed(lists).unionByName(checked).unionByName(_from_windows(anew, link, size, range(FRESH), 0))
            lists = materialize(_lists(more, size), "embed-lists")
        for k in range(ROUNDS):
            after = materialize(_lists(_listed(lists).unionByName(_descend(lists, nodes, link, i * ROUNDS + k)), size), "embed-lists")
            forget(lists)
            lists = after
        picked = balls.orderBy(F.xxhash64("bid", F.lit(_SEED + i)), "bid").limit(audited)  # other nodes each time
        checked = materialize(_against_all(balls, picked, link), "embed-audit")
        counts = [_known(checked, lists), _known(beside.withColumnRenamed("bid", "v"), lists)]
        audit += counts
        if not counts[-1][0]:
            break
        if all(known >= recall * n for n, known in counts):
            return real(_listed(lists).unionByName(checked)), audit
    every = None
    n = balls.count()
    turn = F.pmod(F.xxhash64("bid", F.lit(1)), F.lit(max(1, -(-n // EXACT))))
    for k in range(max(1, -(-n // EXACT))):  # blocks of about EXACT leaders as queries against all: exact, and its work grows as the square
        found = materialize(_against_all(balls, balls.filter(turn == k), link), "embed-exact")
        every = found if every is None else every.unionByName(found)
    return every, audit


def _settle(rows: DataFrame, classes: DataFrame, member: DataFrame, balls: DataFrame, links: DataFrame, threshold: float, link: float, key: str) -> DataFrame:
    """Exact links from the pairs of balls that the graph names."""
    e = links.filter("sim >= lim").select(F.least("v", "n").alias("a"), F.greatest("v", "n").alias("b")).distinct()
    size = balls.select("bid", "radius", "weight", "n")
    pairs = _with_angle(e, classes, "a", "b")
    for s in ("a", "b"):
        pairs = pairs.join(size.select(F.col("bid").alias(s), F.col("radius").alias(f"r{s}"), F.col("weight").alias(f"w{s}"), F.col("n").alias(f"n{s}")), s)
    reach = F.col("ra") + F.col("rb")
    single = (F.col("na") == 1) & (F.col("nb") == 1)
    whole = F.when(single, F.col("cos") >= threshold).otherwise(F.col("angle") + reach <= link - 1e-9)
    part = ~single & ~whole & (F.col("angle") - reach <= link + 1e-9)
    pairs = materialize(pairs.withColumn("whole", whole).withColumn("part", part).filter("whole OR part"), "embed-pairs")

    full = pairs.filter("whole")
    to_ball = full.select(F.col("a").alias("bid"), F.col("wb").alias("w")).unionByName(full.select(F.col("b").alias("bid"), F.col("wa").alias("w")))
    some = materialize(_by_blocks(pairs.filter("part").select("a", "na", "b", "nb"), member, classes, threshold), "embed-some")
    to_class = some.filter("w > 0").groupBy("cid").agg(F.sum("w").alias("more"))
    linked = full.select("a", "b").unionByName(some.filter("w > 0").select("a", "b")).distinct()

    parts = connected_components(linked, "a", "b", "embed-parts")
    ball = size.join(to_ball.groupBy("bid").agg(F.sum("w").alias("extra")), "bid", "left").join(parts.select(F.col("node").alias("bid"), "component"), "bid", "left")
    ball = materialize(ball.select("bid", "n", (F.col("weight") - 1 + F.coalesce("extra", F.lit(0))).alias("base"), F.coalesce("component", "bid").alias("component")), "embed-ball")
    placed = attach(member.select("cid", "bid"), ball, "bid", "n", F.col("cid"))
    placed = placed.join(to_class, "cid", "left").join(classes.select("cid", "same", "mult", "first"), "cid")
    placed = materialize(placed.select("same", "mult", "first", "component", (F.col("base") + F.coalesce("more", F.lit(0))).alias("n_links")), "embed-placed")
    first = placed.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("_n"))
    of_class = attach(placed, first, "component", "_n", F.xxhash64("same")).select("same", "mult", "n_links", "component_id")
    out = attach(rows.select("uid", "key", "same"), of_class, "same", "mult", F.col("uid"))
    one = F.when(F.col("same").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), one.alias("component_id"), one.eqNullSafe(F.col("key")).alias("kept"))


def _by_blocks(pairs: DataFrame, member: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cid, w) of pairs of balls some of whose members link: each member with the vectors of the other ball that it links to.

    Members are dealt into blocks of about MEMBERS, which are compared as matrices. A row stands for a member
    and a block of the other ball, not for a pair of members.
    """
    ball = pairs.select(F.col("a").alias("bid"), F.col("na").alias("n")).unionByName(pairs.select(F.col("b").alias("bid"), F.col("nb").alias("n"))).distinct()
    blocks_of = lambda n: F.ceil(F.col(n) / MEMBERS).cast("int")
    mine = member.select("cid", "bid", "mult").join(ball.select("bid", blocks_of("n").alias("k")), "bid")
    mine = mine.select("cid", "bid", "mult", F.pmod(F.xxhash64("cid"), F.col("k")).cast("int").alias("k")).join(classes.select("cid", "unit"), "cid")
    block = materialize(mine.groupBy("bid", "k").agg(F.collect_list(F.struct("cid", "mult", "unit")).alias("m")), "embed-blocks")
    grid = pairs.select("a", F.explode(F.sequence(F.lit(0), blocks_of("na") - 1)).alias("ka"), "b", "nb").select("a", "ka", "b", F.explode(F.sequence(F.lit(0), blocks_of("nb") - 1)).alias("kb"))
    for s in ("a", "b"):
        grid = grid.join(block.select(F.col("bid").alias(s), F.col("k").alias(f"k{s}"), F.col("m").alias(f"m{s}")), [s, f"k{s}"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i] for j, n in enumerate(("a", "b", "ma", "mb"))}
                side = [row[s].values for s in ("ma", "mb")]
                x, y = (np.stack(_matrix(s.field("unit"))) for s in side)
                hit = x @ y.T >= threshold
                weight = [s.field("mult").to_numpy() for s in side]
                ids = [s.field("cid").to_numpy() for s in side]
                cid, w = np.concatenate(ids), np.concatenate([hit @ weight[1], hit.T @ weight[0]])
                at = np.flatnonzero(w)
                if len(at):
                    ends = [pa.array(np.full(len(at), row[s].as_py()), pa.int64()) for s in ("a", "b")]
                    yield pa.RecordBatch.from_arrays([*ends, pa.array(cid[at], pa.int64()), pa.array(w[at], pa.int64())], ["a", "b", "cid", "w"])

    spread = grid.select("a", "b", "ma", "mb")
    return spread.mapInArrow(compare, "a long, b long, cid long, w long")
