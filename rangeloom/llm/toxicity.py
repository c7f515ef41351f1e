"""Toxicity scores from a classifier trained on positive and unlabelled text.

Only confirmed toxic examples and unlabelled text enter the risk.  With the class
prior p the risk of a scorer is

    p * E_pos[loss(+)]  +  max(0, E_all[loss(-)] - p * E_pos[loss(-)]),

the non-negative estimate: whenever a batch drives the second part below zero, the
step goes uphill on it instead, which keeps a flexible model from memorizing the
positives.  The scorer is a logistic model over the distinct letter runs of a text
and their first 4, 5 and 6 bytes, lower-cased in ASCII, as far
as they are several times as frequent in confirmed examples as in unlabelled text.

The model is fitted on bounded samples, `positive_rows` confirmed examples and
`unlabelled_rows` texts with the smallest hash of their id; every text is scored.
The prior is the share of toxic rows among the labels that may be learnt from.

Edge cases: null and empty texts score the model's bias.  Without a confirmed
example nothing can be learnt, and every score is the prior (0 without labels).
Repeated rows are scored once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, mix, slices

POSITIVE_ROWS, UNLABELLED_ROWS = 2000, 8000
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
MAX_FEATURES = 20_000
#: A feature must be this many times as frequent in confirmed examples as in unlabelled text.
LEAST_LIFT = 5.0

_GAP = np.ones(256, dtype=bool)
_GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) for every letter run and prefix, repeats included."""
    sums = w.sums(lower=True)
    size = w.ends - w.starts
    rows, keys = [w.row], [Words.span_hashes(sums, w.starts, w.ends)]
    for n in PREFIXES:
        long = size > n
        rows.append(w.row[long])
        starts = w.starts[long]
        keys.append(mix(Words.span_hashes(sums, starts, starts + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(keys)


def known_features(w: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, index into the sorted vocabulary), by row."""
    if not len(vocabulary):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, key = features(w)
    at = np.minimum(np.searchsorted(vocabulary, key), len(vocabulary) - 1)
    hit = vocabulary[at] == key
    both = np.unique(row[hit] * len(vocabulary) + at[hit])
    return both // len(vocabulary), both % len(vocabulary)


def _rows_of(text: DataFrame, vocabulary: np.ndarray | None) -> list[np.ndarray]:
    """Each text's distinct features: 64-bit keys, or indices into a vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, w in slices(batch.column("text"), gap=_GAP):
                if vocabulary is None:
                    row, key = features(w)
                    order = np.lexsort((key, row))
                    row, key = row[order], key[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
                    row, key = row[new], key[new]
                else:
                    row, key = known_features(w, vocabulary)
                    key = key.astype(np.uint32)
                parts = np.split(key, np.searchsorted(row, np.arange(1, w.rows)))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in parts], pa.binary())], names=["x"])

    kind = np.uint64 if vocabulary is None else np.uint32
    return [np.frombuffer(r.x, kind) for r in text.select("text").mapInArrow(work, "x binary").collect()]


class Sparse:
    """Rows of feature indices."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.rows, self.width = rows, width

    def batch(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.rows[i] for i in which]
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.uint32)]).astype(np.int64)


def train(positive: Sparse, unlabelled: Sparse, prior: float, epochs: int = 400, batches: int = 1, rate: float = 0.05, ridge: float = 5e-5, seed: int = 7):
    """Weights and bias of the non-negative risk's minimum, by Adam over mini-batches."""
    rng = np.random.default_rng(seed)
    w = np.zeros(positive.width + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(w), np.zeros_like(w)
    step = 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(epochs):
        for p_part, u_part in zip(np.array_split(rng.permutation(len(positive.rows)), batches), np.array_split(rng.permutation(len(unlabelled.rows)), batches)):
            if not len(p_part) or not len(u_part):
                continue
            pr, pf = positive.batch(p_part)
            ur, uf = unlabelled.batch(u_part)
            zp = np.bincount(pr, w[pf], len(p_part)) + w[-1]
            zu = np.bincount(ur, w[uf], len(u_part)) + w[-1]
            below = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            # d loss(+)/dz = sigmoid(z) - 1, d loss(-)/dz = sigmoid(z)
            gp_plus, gp_minus = prior * (sigmoid(zp) - 1) / len(zp), -prior * sigmoid(zp) / len(zp)
            gu = sigmoid(zu) / len(zu)
            gp = gp_plus + gp_minus if below >= 0 else -gp_minus
            gu = gu if below >= 0 else -gu
            grad = np.zeros_like(w)
            grad[:-1] = np.bincount(pf, gp[pr], positive.width) + np.bincount(uf, gu[ur], positive.width) + ridge * w[:-1]
            grad[-1] = gp.sum() + gu.sum()
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad**2
            w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _sample(docs: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """The texts of the `rows` ids with the smallest hash; the list of ids is bounded by `rows`."""
    chosen = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, learnable: F.Column | None = None, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS):
    """(sorted vocabulary, weights, bias) from documents whose id is `learnable`."""
    may = F.lit(True) if learnable is None else learnable
    known = labels.where(may & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    empty = np.zeros(0, np.uint64), np.zeros(0)
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n or not toxic:
        return *empty, -40.0
    prior = float(min(max(toxic / n, 1e-4), 1 - 1e-4))
    positive = _rows_of(_sample(docs, known.where("toxic > 0"), positive_rows), None)
    if not positive:
        return *empty, float(np.log(prior / (1 - prior)))
    keys, times = np.unique(np.concatenate(positive), return_counts=True)
    often = np.argsort(-times, kind="stable")[:MAX_FEATURES]
    vocabulary = np.sort(keys[often[times[often] >= max(3, 0.005 * len(positive))]])
    seen = _rows_of(_sample(docs, docs.where(may), unlabelled_rows), vocabulary)
    own = [np.flatnonzero(np.isin(vocabulary, x)) for x in positive]
    rate = lambda rows: np.bincount(np.concatenate(rows).astype(np.int64), minlength=len(vocabulary)) / max(1, len(rows))
    usual = rate(seen) if seen else np.zeros(len(vocabulary))
    chance = len(own) * usual  # and not by chance: some standard deviations above what unlabelled text predicts
    kept = (rate(own) >= LEAST_LIFT * usual) & (len(own) * rate(own) >= chance + 4 * np.sqrt(chance + 0.25))
    if not kept.any():
        return *empty, float(np.log(prior / (1 - prior)))
    place = np.cumsum(kept) - 1
    narrow = lambda rows: Sparse([place[x[kept[x]]].astype(np.uint32) for x in rows], int(kept.sum()))
    weights, bias = train(narrow(own), narrow(seen), prior)
    return vocabulary[kept], weights, bias


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` (which must have text) with score and predicted added; columns of these names are replaced."""
    vocabulary, weights, bias = model
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column("text"), gap=_GAP):
                row, at = known_features(w, vocabulary)
                z = np.bincount(row, weights[at], w.rows)[: w.rows] + bias
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(work, schema)
