"""Language identification by nearest centroid.

A text is its vector of hashed character n-grams (n = 1 to 3, letters in lower case, everything else a
space), weighted by TF-IDF and of length one. Each language has several centroids, found by spherical
k-means among its sample. The language is that of the centroid of the largest cosine; a text that is too
far from all of them is rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize

#: Hash buckets, centroids of a language, and sampled texts of a language at most about.
BUCKETS, CENTROIDS, SAMPLE = 8_192, 3, 400
#: Texts whose best cosine is below this share of the worst that sampled texts of as many letters show are rejected.
REJECT = 0.3
UNDETERMINED = "und"
_SEED = 17
_CHUNK = 1 << 20


def letter_table() -> np.ndarray:
    """Whether each code point of the basic plane is a letter."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(1 << 16)])


def ngram_counts(text: str | None, letters: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """(counts by bucket, letters of the text). Long texts are read whole, in chunks; an n-gram counts in the chunk where it ends."""
    counts = np.zeros(buckets, np.int64)
    n_letters = 0
    if not text:
        return counts, 0
    text = text.lower()
    tail = np.array([32], np.uint64)
    for a in range(0, len(text), _CHUNK):
        cp = np.frombuffer(text[a : a + _CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        is_letter = letters[np.minimum(cp, 0xFFFF)]
        high = cp > 0xFFFF
        if high.any():
            is_letter[high] = [unicodedata.category(chr(int(x)))[0] == "L" for x in cp[high]]
        n_letters += int(is_letter.sum())
        cp[~is_letter] = 32
        cp = np.concatenate([tail, cp, [np.uint64(32)]] if a + _CHUNK >= len(text) else [tail, cp])
        cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])]
        with np.errstate(over="ignore"):
            one = cp * np.uint64(0x9E3779B97F4A7C15)
            two = (one[:-1] ^ (one[:-1] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + one[1:]
            three = (two[:-1] ^ (two[:-1] >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + one[2:]
        old = len(tail) if a else 0
        for n, h in enumerate((one, two, three)):
            h = h[max(0, old - n) :]
            counts += np.bincount(((h ^ (h >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        tail = cp[-2:]
    return counts, n_letters


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    #: The least cosine that a text may have, by the binary logarithm of its letters.
    least: np.ndarray

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, cosine) by row of counts; ties go to the earlier centroid."""
        x = np.log1p(counts).astype(np.float32) * self.idf
        norm = np.sqrt((x * x).sum(1))
        sim = (x @ self.centroids.T) / np.where(norm > 0, norm, 1)[:, None]
        best = sim.argmax(1)
        return self.owner[best], np.clip(sim[np.arange(len(sim)), best].astype(float), 0, 1)

    def rejects(self, cosine: np.ndarray, letters: np.ndarray) -> np.ndarray:
        return cosine < self.least[np.minimum(np.log2(np.maximum(1, letters)).astype(int), len(self.least) - 1)]


def spherical_kmeans(x: np.ndarray, k: int, seed: int = _SEED, rounds: int = 12) -> np.ndarray:
    """k centroids of length one of unit rows; fewer where there are fewer different rows."""
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x)))]]
    while len(c) < k:
        far = 1 - (x @ c.T).max(1)
        if far.max() < 1e-6:
            break
        c = np.concatenate([c, x[[int(far.argmax())]]])
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        new = np.stack([x[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        new = new / np.where(norm > 0, norm, 1)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def _counts_of(text: Column) -> Column:
    @F.pandas_udf("struct<i:array<int>,n:array<int>,letters:long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for texts in batches:
            where, how, size = [], [], []
            for t in texts:  # only what isn't zero is kept, text by text
                c, n = ngram_counts(t if isinstance(t, str) else None, letters)
                at = np.flatnonzero(c)
                where.append(at.astype(np.int32))
                how.append(np.minimum(c[at], 2**31 - 1).astype(np.int32))
                size.append(n)
            yield pd.DataFrame({"i": where, "n": how, "letters": size})

    return run(text)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, centroids: int = CENTROIDS, seed: int = _SEED) -> Model | None:
    """A model from texts of known language; None without any (an empty table, or no text with letters and language).

    Rows without text or language are left out. About `sample` texts of each language are drawn by hash of key
    and text (all of a language with fewer), so that neither null nor repeated keys are drawn as one. Counts of
    sampled texts are written once; what is gathered is a document frequency for each bucket and the centroids
    of each language, whose k-means runs in one task over its sample. Other columns are ignored.
    """
    spark = docs.sparkSession
    known = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("_k"), F.col(lang).alias("_l"), F.col(text).alias("_t"))
    rates = known.groupBy(F.col("_l").alias("_r")).agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("rate"))
    rates = materialize(rates, "language-rates")
    draw = F.pmod(F.xxhash64("_k", "_t", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    drawn = known.join(rates, F.col("_l") == F.col("_r")).filter(draw < F.col("rate")).select("_l", _counts_of(F.col("_t")).alias("c"))
    # A filter on the counts would be pushed below the sampling, and all texts would be counted; so it comes after writing.
    counted = materialize(drawn.select("_l", "c.i", "c.n", "c.letters"), "language-counts").filter("letters > 0")
    n = counted.count()
    if not n:
        return None
    df = np.zeros(BUCKETS)
    for r in counted.select(F.explode("i").alias("i")).groupBy("i").count().collect():
        df[r["i"]] = r["count"]
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(i=rows["i"].map(tuple), n=rows["n"].map(tuple)).sort_values(["letters", "i", "n"])
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for at, i, m in zip(range(len(rows)), rows["i"], rows["n"], strict=True):
            x[at, list(i)] = np.log1p(m)
        x *= idf
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        own = spherical_kmeans(x, centroids, seed)
        size, near = np.log2(rows["letters"].to_numpy()).astype(int), (x @ own.T).max(1)
        worst = [float(near[size == s].min()) if (size == s).any() else None for s in range(40)]
        return pd.DataFrame({"lang": rows["_l"].iloc[0], "c": [c.tobytes() for c in own], "worst": [worst] * len(own)})

    got = sorted(counted.groupBy("_l").applyInPandas(cluster, "lang string, c binary, worst array<double>").collect(), key=lambda r: (r.lang, bytes(r.c)))
    languages = sorted({r.lang for r in got})
    owner = np.array([languages.index(r.lang) for r in got])
    worst = np.array([[np.nan if w is None else w for w in r.worst] for r in got])
    known_sizes = np.flatnonzero(~np.isnan(worst).all(0))
    least = np.full(40, np.inf)
    least[known_sizes] = np.nanmin(worst[:, known_sizes], axis=0)
    # Fewer letters give smaller cosines: what holds for longer texts doesn't bind shorter ones.
    floor = np.minimum.accumulate(least[::-1])[::-1]
    floor = np.where(np.isinf(floor), least[known_sizes].min(), floor)
    floor[: known_sizes.min()] = 0.0
    return Model(languages, idf, np.stack([np.frombuffer(r.c, np.float32) for r in got]), owner, floor * REJECT)


def predict(text: Column, model: Model | None) -> Column:
    """struct<lang, score, rejected> of whole texts: the nearest language with its cosine; `und` and 0 without letters or without a model.

    rejected: without letters, or too far from all centroids. Languages are named even then. Null and empty texts
    have no letters; ties go to the earlier centroid.
    """
    names = [*(model.languages if model else []), UNDETERMINED]

    @F.pandas_udf("struct<lang:string,score:double,rejected:boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for texts in batches:
            lang, cos, bad = [], [], []
            for a in range(0, len(texts), 64):
                got = [ngram_counts(t if isinstance(t, str) else None, letters) for t in texts.iloc[a : a + 64]]
                n = np.array([g[1] for g in got])
                if model is None:
                    who, sim, no = np.zeros(len(got), int), np.zeros(len(got)), np.ones(len(got), bool)
                else:
                    who, sim = model.nearest(np.stack([g[0] for g in got]))
                    no = model.rejects(sim, n) | (n == 0)
                who, sim = np.where(n > 0, who, len(names) - 1), np.where(n > 0, sim, 0.0)
                lang += [names[i] for i in who]
                cos += sim.tolist()
                bad += no.tolist()
            yield pd.DataFrame({"lang": lang, "score": cos, "rejected": bad})

    return run(text)
