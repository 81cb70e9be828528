"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints of whole texts are made distinct. Pairs within the radius agree on at least one of
radius + 1 blocks of bits, so fingerprints are dealt to tasks by each block's value; each value is a tree
of the index. In a tree they are sorted by Gray rank, in which fingerprints that share bits stand together.
Runs of them form leaves; a leaf keeps the bits that all of them share, upper nodes keep what their leaves
share, and each level holds only the bits that the level above does not. A search adds up differences from
the top and leaves a whole group as soon as they exceed the radius; in large trees also once all of it is
already joined to what is searched. All links are found by this search, in trees of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.skew import attach
from ..plans.storage import materialize, parallelism

#: Words in a shingle, seed of the hash, most differing bits of a link.
SHINGLE, SEED, RADIUS = 3, 42, 3
#: Rows of an index node; trees up to this size are searched together; those beyond the last are dealt anew by further bits.
FAN, SMALL, LARGE = 8, 256, 100_000
#: Pairs of a query and an index node that a search holds at about once.
FRONTIER = 1 << 18


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a whole text as a signed 64-bit number: XXH64 of k-word shingles, repeats included; 0 without words.

    A-Z are lower-cased; words are runs of characters other than ASCII white space.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return int(np.uint64(h(joined, seed)).astype(np.int64))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ones, n = np.zeros(64, np.int64), len(words) - k + 1
    for a in range(0, n, 1 << 16):  # long texts take no more memory
        b = min(n, a + (1 << 16))
        hashes = np.fromiter((h(joined[s : e - 1], seed) for s, e in zip(starts[a:b], starts[a + k : b + k], strict=True)), np.uint64, b - a)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(text: Column) -> Column:
    """fingerprint() of a text column."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t if isinstance(t, str) else None) for t in texts], dtype="int64")

    return run(text)


def gray_rank(fp: Column) -> Column:
    """The place of a bit pattern in Gray order, as a number whose unsigned order that is."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def _blocks(radius: int, low: int = 0, high: int = 64) -> list[tuple[int, int]]:
    """[from, to) of radius + 1 blocks of bits."""
    cuts = [low + (high - low) * i // (radius + 1) for i in range(radius + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _bits(fp: Column, a: int, b: int) -> Column:
    return F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))


def _keyed(fps: DataFrame, radius: int, large: int) -> DataFrame:
    """(group, fp): each fingerprint once for each block. In groups above `large`, pairs still differ in
    at most `radius` of the other bits, so those are cut into blocks again, and each fingerprint stands once for each of them."""
    blocks = _blocks(radius)
    e = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _bits(F.col("fp"), a, b).alias("value")) for i, (a, b) in enumerate(blocks)])).alias("k")).select("fp", "k.block", "k.value")
    n = e.groupBy("block", "value").agg(F.count("*").alias("n"))
    # At most (radius + 1) * rows / large groups are that large; so many are too few to matter unless shuffled as they are.
    big = n.filter(F.col("n") > large).select("block", "value", F.lit(True).alias("big"))
    e = e.join(big, ["block", "value"], "left")

    def others(i: int, a: int, b: int) -> Column:
        kept = F.col("fp").bitwiseAND(F.lit((1 << a) - 1))
        if b < 64:
            kept = kept.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col("fp"), b), a))
        return F.array(*[F.struct(F.lit(j + 1).alias("j"), _bits(kept, x, y).alias("v")) for j, (x, y) in enumerate(_blocks(radius, 0, 64 - (b - a)))])

    whole = F.array(F.struct(F.lit(0).alias("j"), F.lit(0).cast("long").alias("v")))
    more = whole
    for i, (a, b) in enumerate(blocks):
        more = F.when(F.col("big") & (F.col("block") == i), others(i, a, b)).otherwise(more)
    return e.select("fp", "block", "value", F.explode(more).alias("m")).select(F.xxhash64("block", "value", "m.j", "m.v").alias("group"), "fp")


class GrayIndex:
    """Hierarchical index over distinct fingerprints in Gray order: one tree for each of the groups, whose members stand together."""

    def __init__(self, fps: np.ndarray, groups: np.ndarray | None = None, radius: int = RADIUS, fan: int = FAN) -> None:
        self.fps, self.radius = fps, radius
        tree = np.zeros(len(fps), int) if groups is None else np.concatenate([[0], np.cumsum(groups[1:] != groups[:-1])])
        self.tree = tree
        self.root_level, self.root = np.zeros(tree[-1] + 1, int), np.zeros(tree[-1] + 1, int)
        #: Bottom up: pattern, mask of the bits that all below share, [first, last) child.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        ones, shared, at = fps, np.full(len(fps), ~np.uint64(0)), np.arange(len(fps))
        while len(at):
            own = tree[at]
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
            cut = np.flatnonzero(place % fan == 0)
            some = ones[at] & shared[at]
            both, either = np.bitwise_and.reduceat(some, cut), np.bitwise_or.reduceat(some, cut)
            mask = np.bitwise_and.reduceat(shared[at], cut) & ~(both ^ either)
            self.levels.append((both & mask, mask, at[cut], at[np.append(cut[1:], len(at)) - 1] + 1))
            tree = own[cut]
            n = np.bincount(tree)[tree]
            alone = np.flatnonzero(n == 1)
            self.root_level[tree[alone]], self.root[tree[alone]] = len(self.levels) - 1, alone
            ones, shared, at = both & mask, mask, np.flatnonzero(n > 1)

    def search(self, a: int, b: int, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, later or equal-labelled member) places of links of the fingerprints [a, b) in their own trees.

        With labels (of a single tree) members whose label is already the searched one's are left out, by whole groups.
        """
        uniform: list[np.ndarray] = []
        lab = labels
        for _, _, first, _ in self.levels if labels is not None else ():
            least, most = np.minimum.reduceat(lab, first), np.maximum.reduceat(np.where(lab < 0, np.iinfo(np.int64).max, lab), first)
            lab = np.where((least == most) & (least >= 0), least, -1)
            uniform.append(lab)
        queries, trees = self.fps[a:b], self.tree[a:b]
        q, node, acc, above = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.widest = 0
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, mask, first, last = self.levels[level]
            enter = np.flatnonzero(self.root_level[trees] == level)
            q, node = np.concatenate([q, enter]), np.concatenate([node, self.root[trees[enter]]])
            acc, above = np.concatenate([acc, np.zeros(len(enter), np.int64)]), np.concatenate([above, np.zeros(len(enter), np.uint64)])
            acc = acc + np.bitwise_count((queries[q] ^ pattern[node]) & (mask[node] & ~above))
            keep = acc <= self.radius
            if uniform:
                keep &= uniform[level][node] != labels[a:b][q]
            q, node, acc = q[keep], node[keep], acc[keep]
            n = last[node] - first[node]
            above, q, acc = np.repeat(mask[node], n), np.repeat(q, n), np.repeat(acc, n)
            node = np.repeat(first[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            self.widest = max(self.widest, len(node))
        acc = acc + np.bitwise_count((queries[q] ^ self.fps[node]) & ~above)
        keep = (acc <= self.radius) & (node > q + a if labels is None else labels[node] != labels[a:b][q])
        return q[keep] + a, node[keep]


def _join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of a component) after the pairs i, j are joined."""
    while True:
        a, b = labels[i], labels[j]
        if (a == b).all():
            return labels
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(labels, high, low)
        while (labels != labels[labels]).any():
            labels = labels[labels]


def link_group(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of a tree's distinct fingerprints in Gray order, the first place of its component."""
    index, labels = GrayIndex(fps, radius=radius), np.arange(len(fps))
    # So few queries at once that even without pruning the search stays within bounds; more once it prunes.
    step = max(1, min(512, FRONTIER // len(fps)))
    a = 0
    while a < len(fps):
        b = min(len(fps), a + step)
        labels = _join_labels(labels, *index.search(a, b, labels))
        a = b
        step = min(512, 2 * step) if index.widest < FRONTIER // 4 else max(1, min(step, FRONTIER // len(fps)))
    return labels


def link_groups(groups: np.ndarray, fps: np.ndarray, radius: int = RADIUS, small: int = SMALL) -> np.ndarray:
    """For each fingerprint, the first place of its component within its group. Groups stand together, in Gray order."""
    labels = np.arange(len(fps))
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(fps) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(fps)))
    size = np.repeat(sizes, sizes)
    few = np.flatnonzero((size > 1) & (size <= small))
    if len(few):
        index = GrayIndex(fps[few], groups[few], radius)
        seen = np.cumsum(size[few])  # what a search without any pruning would hold
        cuts = np.unique(np.append(np.searchsorted(seen, np.arange(0, seen[-1], FRONTIER)), len(few)))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i, j = index.search(a, b)
            labels = _join_labels(labels, few[i], few[j])
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        labels[s : s + n] = s + link_group(fps[s : s + n], radius)
    return labels


def _link(radius: int, small: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def work(g: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            labels = link_groups(g, f, radius, small)
            at = np.flatnonzero(labels != np.arange(len(f)))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (f[at], f[labels[at]])], ["src", "dst"])

        for batch in batches:
            g = np.concatenate([groups, batch.column(0).to_numpy()])
            f = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            cut = len(g) if not len(g) else int(np.flatnonzero(g != g[-1])[-1]) + 1 if (g != g[-1]).any() else 0
            yield from work(g[:cut], f[:cut])
            groups, fps = g[cut:], f[cut:]
        yield from work(groups, fps)

    return run


def fingerprint_components(fps: DataFrame, radius: int = RADIUS, small: int = SMALL, large: int = LARGE) -> DataFrame:
    """(fp, root) of distinct fingerprints (column fp): root is the same for all that chains of links join."""
    parts = parallelism(fps.sparkSession)
    keyed = _keyed(fps, radius, large).withColumn("rank", gray_rank(F.col("fp")).bitwiseXOR(F.lit(-(1 << 63))))
    ready = keyed.repartition(parts, "group").sortWithinPartitions("group", "rank")
    edges = materialize(ready.select("group", "fp").mapInArrow(_link(radius, small), "src long, dst long"), "simhash-edges")
    roots = connected_components(edges, label="simhash-components").select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return fps.select("fp").join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: key, fp (signed), fingerprint (hex) and component_id, the smallest key that links reach.

    Texts without words (null, empty, white space) have fingerprint zero and link like others. Long texts
    are read whole. Repeated rows are repeated; a null key names no component. An empty table gives no rows;
    other columns are ignored.
    """
    rows = materialize(docs.select(F.col(key).alias("_key"), fingerprints(F.col(text)).alias("fp")), "simhash-docs")
    return components_of(rows, radius).select(F.col("_key").alias(key), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def components_of(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows(_key, fp) with component_id."""
    fps = materialize(rows.groupBy("fp").agg(F.min("_key").alias("first"), F.count("*").alias("n")), "simhash-distinct")
    placed = fps.join(fingerprint_components(fps, radius), "fp")
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("_n"))
    of_fp = materialize(attach(placed, lowest, "root", "_n", F.col("fp")).select("fp", "n", "component_id"), "simhash-placed")
    return attach(rows, of_fp, "fp", "n", F.xxhash64("_key"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the smallest key (nulls last), of several such that of the smallest fingerprint.

    Rows are told apart by key and fingerprint, so unlike documents that share a key, or have none, all stay;
    of rows that agree in both, one stays. Texts without words link with each other, so one of them stays.
    An empty table gives no rows. Columns stay as they are, whatever their names.
    """
    fp = next(f"_fp{i}" for i in range(len(docs.columns) + 1) if f"_fp{i}" not in docs.columns)
    tagged = materialize(docs.withColumn(fp, fingerprints(F.col(text))), "simhash-docs")
    counted = tagged.groupBy(F.col(fp).alias("fp"), F.col(key).alias("_key")).agg(F.count("*").alias("c"))
    fps = materialize(counted.groupBy("fp").agg(F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "c")).alias("m")), "simhash-distinct")
    placed = fps.join(fingerprint_components(fps, radius), "fp")
    best = placed.groupBy("root").agg(F.min(F.struct("m.none", "m._key", "fp", "m.c")).alias("b"))
    kept = materialize(best.select(F.col("b._key").alias("_kept"), F.col("b.fp").alias("_kept_fp"), F.col("b.c").alias("_n")), "simhash-kept")
    # The list grows with the documents: it is merged at every size, and not broadcast while it happens to be small.
    out = tagged.join(kept.hint("merge"), tagged[key].eqNullSafe(kept["_kept"]) & (tagged[fp] == kept["_kept_fp"]), "left_semi")
    if not kept.filter("_n > 1").isEmpty():
        out = out.dropDuplicates([key, fp])
    return out.drop(fp)
