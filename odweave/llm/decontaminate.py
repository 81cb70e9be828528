"""Benchmark decontamination by SimHash windows of the size of the benchmark's items.

For each item length, windows of as many words slide over a text, word by word. A window and an item
whose SimHashes (of words) differ in at most RADIUS bits become a candidate; the items are found by
multi-index blocks: of BLOCKS blocks of bits one differs in at most RADIUS // BLOCKS bits, so tables of all
block values that near guarantee every item within the radius. At a similarity of 0.8 at most a ninth of the
words differ, which is 27 degrees and 10 of 64 bits on average; the radius lies 4.6 standard deviations above. Candidates are verified by the weighted
Jaccard similarity of their word shingles (the weight of a shingle is how often it occurs).

A window's similarity to any item is at most what the benchmark's shingles in it allow, so windows with too
few of them are left out before they are hashed; that loses no match.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a fingerprint that may differ, and blocks that they are cut into.
RADIUS, BLOCKS = 23, 8
#: Words and items of the benchmark that one pass compares with all texts; a larger benchmark takes several passes, one index at a time.
PASS_WORDS, PASS_ITEMS = 400_000, 2_000
#: Windows that are hashed at a time, and words.
WINDOWS, WORDS = 4096, 1 << 14

_WORD = re.compile(r"\w+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def shingles_of(words: list[str], k: int = SHINGLE) -> Counter:
    """k-word shingles with their counts; of fewer words, the whole sequence."""
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def weighted_jaccard(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[x]) for x, n in a.items() if x in b)
    both = a.total() + b.total() - common
    return common / both if both else 0.0


def _bit_signs(words: list[str]) -> np.ndarray:
    """A row of 64 signs for each word."""
    h = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in words], "<u8")
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits((sums > 0).astype(np.uint8), axis=1, bitorder="little").view("<u8").ravel()


class BenchmarkIndex:
    """What a pass needs of its items: vocabulary, shingles, fingerprints and block tables."""

    def __init__(self, items: list[tuple[int, str]], k: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> None:
        self.k, self.similarity, self.radius, self.blocks = k, similarity, radius, blocks
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.bags = [shingles_of(w, k) for _, w in self.items]
        self.lengths = sorted({len(w) for _, w in self.items})
        vocabulary = sorted({x for _, w in self.items for x in w})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        # Rolling hashes of the items' shingles; a text's shingle of that hash may be one of theirs.
        self.sizes = sorted({min(k, n) for n in self.lengths})
        self.hashes = {s: np.unique(np.concatenate([self._rolled(self._coded(w), s) for _, w in self.items if min(k, len(w)) == s])) for s in self.sizes}
        self.own = {n: np.unique(np.concatenate([self._rolled(self._coded(w), min(k, n)) for _, w in self.items if len(w) == n])) for n in self.lengths}
        prints = np.array([_pack(_bit_signs(w).sum(0, keepdims=True))[0] for _, w in self.items], np.uint64) if self.items else np.zeros(0, np.uint64)
        self.prints = prints
        self.width = 64 // blocks
        self.near = np.array([0] + [sum(1 << b for b in c) for r in range(1, radius // blocks + 1) for c in combinations(range(self.width), r)], np.uint64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in self.lengths:
            own = np.array([i for i, (_, w) in enumerate(self.items) if len(w) == n])
            keys, who = [], []
            for j in range(blocks):
                values = (self._block(prints[own], j)[:, None] ^ self.near[None, :]) | np.uint64(j << self.width)
                keys.append(values.ravel().astype(np.uint32))
                who.append(np.repeat(own.astype(np.int32), len(self.near)))
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            self.tables[n] = key[order], np.concatenate(who)[order]

    def state(self) -> dict:
        """The index as plain values, which workers can read without this package."""
        return self.__dict__

    @classmethod
    def of(cls, state: dict) -> BenchmarkIndex:
        index = cls.__new__(cls)
        index.__dict__ = state
        return index

    def _coded(self, words: list[str]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter((get(w, 0) for w in words), np.uint64, len(words))

    def _rolled(self, ids: np.ndarray, s: int) -> np.ndarray:
        n = max(0, len(ids) - s + 1)
        h = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(s):
                h = h * _PRIME + ids[j : j + n]
                h ^= h >> np.uint64(29)
        return h

    @staticmethod
    def _isin(x: np.ndarray, table: np.ndarray) -> np.ndarray:
        return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x

    def _block(self, prints: np.ndarray, j: int) -> np.ndarray:
        return (prints >> np.uint64(j * self.width)) & np.uint64((1 << self.width) - 1)

    def candidates(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all items of n words within the radius of the windows' fingerprints."""
        keys, who = self.tables[n]
        found = []
        for j in range(self.blocks):
            q = (self._block(prints, j) | np.uint64(j << self.width)).astype(np.uint32)
            a, b = np.searchsorted(keys, q, "left"), np.searchsorted(keys, q, "right")
            count = b - a
            w = np.repeat(np.arange(len(prints)), count)
            at = np.repeat(a - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            found.append(np.stack([w, who[at]], 1))
        pairs = np.unique(np.concatenate(found), axis=0)
        close = np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]]) <= self.radius
        return pairs[close, 0], pairs[close, 1]

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that the text holds; of equal ones the first."""
        words = words_of(text)
        if not words or not self.items:
            return []
        ids = self._coded(words)
        hits = {}
        for s in self.sizes:
            known, full = ids != 0, max(0, len(ids) - s + 1)
            run = np.ones(full, bool)
            for j in range(s):
                run &= known[j : j + full]
            at = np.flatnonzero(run)
            rolled = self._rolled(ids, s)[at] if len(at) else np.zeros(0, np.uint64)
            there = self._isin(rolled, self.hashes[s])
            hits[s] = at[there], rolled[there]
        best: dict[int, tuple[float, int]] = {}
        for n in self.lengths:
            s = min(self.k, n)
            at, rolled = hits[s]
            if not len(at) or len(words) < n:
                continue
            at = at[self._isin(rolled, self.own[n])]
            # With c common shingles of m, the similarity of two bags of m is c / (2m - c).
            m = n - s + 1
            need = int(np.ceil(2 * m * self.similarity / (1 + self.similarity) - 1e-9))
            mark = np.zeros(len(words) - s + 2, np.int64)
            mark[at + 1] = 1
            held = np.cumsum(mark)
            starts = np.flatnonzero(held[m:] - held[:-m] >= need)
            for a in range(0, len(starts), WINDOWS):
                self._verify(words, starts[a : a + WINDOWS], n, best)
        return [(self.items[i][0], sim, at, len(self.items[i][1])) for i, (sim, at) in sorted(best.items())]

    def _prefix_sums(self, words: list[str], places: np.ndarray) -> np.ndarray:
        """Sums of the signs of all words before each of the sorted places; words between far places are passed over."""
        sums, total, at = np.zeros((len(places), 64), np.int32), np.zeros(64, np.int32), 0
        for a in range(int(places[0]), int(places[-1]), WORDS):
            b = min(int(places[-1]), a + WORDS)
            stop = int(np.searchsorted(places, b, "right"))
            inner = np.cumsum(_bit_signs(words[a:b]), axis=0, dtype=np.int32)
            here = places[at:stop] - a
            sums[at:stop] = total + np.where((here > 0)[:, None], inner[np.maximum(here, 1) - 1], 0)
            total, at = total + inner[-1], stop
        return sums

    def _verify(self, words: list[str], starts: np.ndarray, n: int, best: dict[int, tuple[float, int]]) -> None:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(starts) > n) + 1, [len(starts)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            near = starts[a:b]
            places = np.unique(np.concatenate([near, near + n]))
            sums = self._prefix_sums(words, places)
            prints = _pack(sums[np.searchsorted(places, near + n)] - sums[np.searchsorted(places, near)])
            for w, i in zip(*self.candidates(prints, n), strict=True):
                at = int(near[w])
                sim = weighted_jaccard(shingles_of(words[at : at + n], self.k), self.bags[i])
                if sim >= self.similarity and (i not in best or (-sim, at) < (-best[i][0], best[i][1])):
                    best[int(i)] = sim, at


def _passes(benchmark: DataFrame, pass_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, one at a time; the benchmark is the query set, all of which is compared with all texts."""
    block: list[tuple[int, str]] = []
    n = 0
    for r in benchmark.select("item_id", "text").filter("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        size = len(words_of(r.text))
        if block and (n + size > pass_words or len(block) >= PASS_ITEMS):
            yield block
            block, n = [], 0
        block.append((r.item_id, r.text))
        n += size
    yield block


MATCH = "item_id long, similarity double, first_word long, n_words long"


def find_contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, pass_words: int = PASS_WORDS) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, similarity, first_word and n_words of the best window.

    Null, empty and wordless texts hold nothing, and null and wordless items are held by nothing; items of
    fewer than k words are one shingle. Whole texts are searched, however long, in bounded memory besides the
    text's words. Repeated documents are reported each; equal items are found each; of equal windows the first
    counts. doc_id is of any type and may be null. Empty tables give no rows; other columns are ignored.
    Where the benchmark takes several passes, each one's rows are written before the next begins.
    """
    spark, out, last = docs.sparkSession, None, None
    ids = docs.select("doc_id")

    for items in _passes(benchmark, pass_words):
        if out is not None:
            out = materialize(out, "contamination")
            last.unpersist()
        last = sent = spark.sparkContext.broadcast(BenchmarkIndex(items, k, similarity).state())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            index = BenchmarkIndex.of(sent.value)
            names, kinds = [c.split(" ")[0] for c in MATCH.split(", ")], [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            for b in batches:
                rows = [(i, *m) for i, t in enumerate(b.column(1).to_pylist()) for m in index.matches(t)]
                if rows:
                    at, *cols = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", *names])

        found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids.dtypes[0][1]}, {MATCH}")
        out = found if out is None else out.unionByName(found)
    return out


def is_contaminated(text: Column, sent) -> Column:  # noqa: ANN001
    """Whether a text holds an item of an index whose state() is broadcast."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        index = BenchmarkIndex.of(sent.value)
        return pd.Series([bool(index.matches(t if isinstance(t, str) else None)) for t in texts], dtype=bool)

    return run(text)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE, pass_words: int = PASS_WORDS) -> DataFrame:
    """docs without those that hold a benchmark item; rows and columns are otherwise as they were.

    Rows are judged one by one, so repeated rows go or stay together and null texts stay. An empty benchmark
    drops nothing. Where the benchmark takes several passes, what one leaves is written before the next begins.
    """
    last = None
    for items in _passes(benchmark, pass_words):
        if last is not None:
            docs = materialize(docs, "decontaminated")
            last.unpersist()
        last = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex(items, k, similarity).state())
        docs = docs.filter(~is_contaminated(F.col("text"), last))
    return docs


def oracle(k: int = SHINGLE, similarity: float = SIMILARITY) -> str:
    """DuckDB SQL for the rows of find_contamination(): every window that shares a shingle with an item, without fingerprints."""
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM benchmark WHERE text IS NOT NULL),
bi AS (SELECT item_id, len(w) AS n, least({k}, len(w)) AS s, w FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, n, s, sh, count(*) AS c FROM (SELECT item_id, n, s, array_to_string(w[p + 1:p + s], ' ') AS sh FROM (SELECT *, unnest(range(n - s + 1)) AS p FROM bi)) GROUP BY ALL),
sizes AS (SELECT DISTINCT s FROM bi),
ds AS (SELECT doc_id, s, p, len(w) AS len_w, array_to_string(w[p + 1:p + s], ' ') AS sh FROM (SELECT doc_id, w, s, unnest(range(greatest(0, len(w) - s + 1))) AS p FROM w, sizes)),
hit AS (SELECT ds.doc_id, bs.item_id, bs.n, bs.s, ds.p, ds.len_w FROM ds JOIN bs ON ds.sh = bs.sh AND ds.s = bs.s),
st AS (SELECT DISTINCT doc_id, item_id, n, s, place FROM (SELECT *, unnest(range(greatest(0, p - (n - s)), least(p, len_w - n) + 1)) AS place FROM hit)),
cm AS (SELECT doc_id, item_id, n, s, place, sum(least(c, have)) AS common FROM (
        SELECT st.doc_id, st.item_id, st.n, st.s, st.place, ds.sh, any_value(bs.c) AS c, count(*) AS have
        FROM st JOIN ds ON st.doc_id = ds.doc_id AND st.s = ds.s AND ds.p BETWEEN st.place AND st.place + st.n - st.s JOIN bs ON bs.item_id = st.item_id AND bs.sh = ds.sh
        GROUP BY st.doc_id, st.item_id, st.n, st.s, st.place, ds.sh) GROUP BY ALL),
sim AS (SELECT *, common / (2 * (n - s + 1) - common) AS similarity FROM cm)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_min(place, (-similarity, place))::BIGINT AS first_word, n::BIGINT AS n_words FROM sim WHERE similarity >= {similarity} GROUP BY doc_id, item_id, n"""
