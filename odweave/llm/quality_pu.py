"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a small network by the non-negative unbiased risk
    pi * R+(g) + max(0, Ru-(g) - pi * R+-(g)),
where pi is the class prior. Where the part in max() falls below zero, the step goes against its
gradient instead, so that the network can't gain by fitting the unlabelled texts. The prior is estimated from
positives and unlabelled texts alone: a classifier of one against the other is cut where the share of
unlabelled texts above the cut, over that of positives, is least (the best bin). Labels 0 are never used: they
train nothing, set no prior and calibrate nothing. Features are shares and ratios of whole texts: no words,
no languages, no names.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positive texts and unlabelled texts in the training sample, at most about. They bound what is learned from, not
#: what is scored; with n of each the prior is known to about 1.5 / sqrt(n), 0.01 here.
SAMPLE_LABELLED, SAMPLE_UNLABELLED = 12_000, 12_000
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 60, 512, 5e-3, 7
#: A text of this score is predicted to have label 1.
CUT = 0.3

_PUNCT = np.array([b for b in range(33, 127) if not chr(b).isalnum()])
N_FEATURES = len(_PUNCT) + 17


def features(text: str | None) -> np.ndarray:
    """Shares and ratios of a whole text; those of an empty one are 0."""
    x = np.zeros(N_FEATURES)
    if not text:
        return x
    raw = text.encode("utf-8", "surrogatepass")
    c = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    n = max(1.0, c.sum() - c[0x80:0xC0].sum())  # characters
    lower, upper, other = c[97:123].sum(), c[65:91].sum(), c[0xC0:].sum()
    words = raw.split()
    nw = max(1, len(words))
    lines = [s for s in raw.split(b"\n") if s.strip()]
    nl = max(1, len(lines))
    distinct = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    short = sum(len(w) < 3 for w in words)
    longest = max(map(len, words), default=0)
    k = len(_PUNCT)
    x[:k] = np.sqrt(c[_PUNCT] / n)
    x[k:] = (
        np.sqrt(upper / n), np.sqrt(lower / n), np.sqrt(other / n), np.sqrt(c[48:58].sum() / n), np.sqrt(c[32] / n), np.sqrt(c[10] / n),
        upper / max(1.0, upper + lower), (c[_PUNCT].sum()) / n, np.log1p(n) / 10, np.log1p(nw) / 10, np.log1p(nl) / 5,
        distinct / nw, np.sqrt(same / nw), len(set(lines)) / nl, short / nw, (n - c[32]) / nw / 10, min(1.0, longest / 50),
    )
    return x


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1: of the logistic loss under the prior, the margin is its log odds."""
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk of margins of positives and unlabelled texts."""
    return float(prior * np.logaddexp(0, -gp).mean() + max(0.0, np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED, hidden: int = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE) -> Model:
    """Minimises the non-negative unbiased risk with the logistic loss by Adam. Rows are features."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    d = both.shape[1]
    p = [rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    zp, zu = (np.clip((a - mean) / scale, -8, 8) for a in (positive, unlabelled))
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30)))
    steps = max(1, -(-max(len(zp), len(zu)) // batch))
    for _ in range(epochs):
        for _ in range(steps):
            xp, xu = zp[rng.integers(0, len(zp), batch)], zu[rng.integers(0, len(zu), batch)]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ p[0] + p[1])
            g = h @ p[2] + p[3][0]
            gp, gu = g[: len(xp)], g[len(xp) :]
            # Loss of saying 1 is log(1 + e^-g), of saying 0 is log(1 + e^g).
            negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            if negative >= 0:
                dp = -prior * sig(-gp) - prior * sig(gp)
                du = sig(gu)
            else:
                dp, du = prior * sig(gp), -sig(gu)
            dg = np.concatenate([dp / len(xp), du / len(xu)])
            dh = dg[:, None] * p[2][None, :] * (1 - h * h)
            grads = [x.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ dg + 1e-4 * p[2], np.array([dg.sum()])]
            t += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, p[0], p[1], p[2], float(p[3][0]), prior=prior)


def best_bin(gp: np.ndarray, gu: np.ndarray, delta: float = 0.1) -> tuple[float, float]:
    """(prior, standard error) from held-out margins of positives and unlabelled texts.

    Above any cut, unlabelled texts hold at least the prior's share of positives, so the ratio of the two
    shares bounds the prior; it is taken at the cut whose upper confidence bound is least.
    """
    cuts = np.unique(gp)
    share = lambda g: 1 - np.searchsorted(np.sort(g), cuts, "left") / len(g)
    p, u = share(gp), share(gu)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(gu)) + 1 / np.sqrt(len(gp)))
    i = int(((u + slack) / p).argmin())
    prior = min(1.0, u[i] / p[i])
    return prior, float(np.sqrt(u[i] * (1 - u[i]) / len(gu) + prior**2 * p[i] * (1 - p[i]) / len(gp)) / p[i])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED) -> float:
    """The class prior, less a standard error since its estimate leans upwards; both halves are held out in turn."""
    rng = np.random.default_rng(seed)
    p, u = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    if min(len(p), len(u)) < 4:
        return 0.5
    got = []
    for i in (0, 1):
        model = fit(p[i::2], u[i::2], 0.5, seed, epochs=EPOCHS // 3)
        got.append(best_bin(model.margin(p[1 - i :: 2]), model.margin(u[1 - i :: 2])))
    prior, error = np.mean(got, axis=0)
    return float(np.clip(prior - error, 0.02, 0.98))


def _feature_rows(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t if isinstance(t, str) else None) for t in texts], dtype=object)

    return run(text)


def train(docs: DataFrame, labels: DataFrame, labelled: int = SAMPLE_LABELLED, unlabelled: int = SAMPLE_UNLABELLED, seed: int = SEED) -> Model:
    """A model from the labels 1 of labels(doc_id, quality) and the texts of docs(doc_id, text).

    Positives are documents with label 1, at most `labelled` of them; the unlabelled texts are drawn from all
    documents, about `unlabelled`. Both samples are by hash, so reruns agree, and their features are gathered.
    Rows of null doc_id or quality label nothing; a document labelled both 1 and 0 counts as labelled 1; null texts have
    the features 0; rows of one id are drawn together. Where ids repeat so often that more than 2 * (labelled + unlabelled)
    rows are drawn, so many of them are taken by a hash of id and text, and a warning is logged. Without a positive or without texts (empty tables)
    the model scores everything 0.5. Other columns are ignored.
    """
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    n, n_docs = good.count(), docs.count()
    draw = lambda *of: F.pmod(F.xxhash64(*of), F.lit(1 << 20)) / float(1 << 20)
    # The bound holds exactly: of an expected 0.9 times as many, the first by hash.
    picked = good.filter(draw("_id", F.lit(seed)) < 0.9 * labelled / max(1, n)).orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"), "left")
    rows = rows.withColumn("_u", draw("doc_id", "text", F.lit(seed + 1)) < 0.9 * unlabelled / max(1, n_docs)).filter(F.col("_id").isNotNull() | F.col("_u"))
    bound = 2 * labelled + 2 * unlabelled
    found = rows.select("doc_id", F.col("_id").isNotNull().alias("_p"), "_u", F.xxhash64("doc_id", "text", F.lit(seed + 2)).alias("_h"), _feature_rows(F.col("text")).alias("x"))
    got = found.orderBy("_h", "doc_id").limit(bound + 1).collect()
    if len(got) > bound:
        got.pop()
        logging.getLogger(__name__).warning("more than %d rows were drawn, as documents repeat ids; the model learns from %d of them, by hash", bound, bound)
    got.sort(key=lambda r: (r.doc_id is not None, 0 if r.doc_id is None else r.doc_id, r.x))
    x = np.array([r.x for r in got]) if got else np.zeros((0, N_FEATURES))
    p, u = (np.array([bool(r[c]) for r in got], bool) for c in ("_p", "_u"))
    if not p.any():
        d = N_FEATURES
        return Model(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0)
    xu = x[u] if u.any() else x
    return fit(x[p], xu, estimate_prior(x[p], xu, seed), seed)


def score(text: Column, model: Model) -> Column:
    """The model's score of whole texts, 0 to 1; null and empty texts have the features 0 and a score too."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = np.array([features(t if isinstance(t, str) else None) for t in texts]).reshape(len(texts), N_FEATURES)
            yield pd.Series(model.score(x), dtype="float64")

    return run(text)
