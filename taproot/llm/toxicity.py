"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, documents without any label the
unlabelled ones; neither held-out labels nor negative ones are ever learnt from.
A linear model on hashed features is fitted with numpy to the
class-prior-corrected risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

with the sigmoid loss l (Kiryo et al., 2017): where the second part falls below
zero, its gradient is climbed instead.  The prior, the share of toxic documents
among all, may be given; else it is that among the labelled ones outside the
held-out fold, the only use of how many others there are.

Features of a text are the words in it, lower-cased, and their beginnings of 4
to 8 bytes: present or not, so neither length nor repetition counts.  Those are
chosen that are surely commoner in positives than in unlabelled text, and of whose
holders, by the prior, a good part are positive.  Training reads a bounded sample:
``most`` positives and ``most`` unlabelled documents at most, by the hash of their
ids; scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taproot.llm.shared import saved
from taproot.llm.sketch import summed
from taproot.llm.words import _BYTE, between, cut, running, slices

U = np.uint64
SPACE = 1 << 20
PREFIXES = (4, 5, 6, 7, 8)


def _features(texts: pa.Array, wanted: np.ndarray | None = None):
    """Per slice: first row, number of rows, and (row, feature) of each distinct feature of a text.

    ``wanted`` tells which features count; others are let go before they are made distinct.
    """
    for lo, hi in slices(texts):
        words = cut(texts.slice(lo, hi - lo), fold=True)
        sums = running(_BYTE[words.buf])
        text = words.text_of().astype(np.int64) * SPACE
        pairs = []
        for p in (None, *PREFIXES):
            if p is None:
                key, row = between(sums, words.start, words.end), text
            else:
                long = words.end - words.start > p
                key, row = between(sums, words.start[long], words.start[long] + p) + U(p), text[long]
            feature = (key & U(SPACE - 1)).astype(np.int64)
            if wanted is not None:
                own = wanted[feature]
                feature, row = feature[own], row[own]
            pairs.append(row + feature)
        pair = np.unique(np.concatenate(pairs))
        yield lo, hi - lo, pair // SPACE, pair % SPACE


@dataclass
class Model:
    features: np.ndarray  # sorted ids of those with a weight
    weights: np.ndarray
    bias: float

    def wanted(self) -> np.ndarray:
        """Whether each feature of the space is one of the model's."""
        out = np.zeros(SPACE, bool)
        out[self.features] = True
        return out

    def scores(self, n: int, row: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Of ``n`` texts, from their features that are the model's."""
        g = np.bincount(row, self.weights[np.searchsorted(self.features, feature)], n) + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def fit_nnpu(row: np.ndarray, col: np.ndarray, positive: np.ndarray, k: int, prior: float, steps: int = 500, rate: float = 0.05, decay: float = 5e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model under the non-negative risk with the sigmoid loss, by Adam.

    ``row`` and ``col`` are the places of the ones among ``len(positive)`` rows, of
    which those not positive are unlabelled, and ``k`` columns.
    """
    n = len(positive)
    of_p, of_u = positive / positive.sum(), ~positive / (~positive).sum()
    w, b = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        s = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + b, -30, 30)))
        negative = (s * of_u).sum() - prior * (s * of_p).sum()
        bend = s * (1 - s)
        down, up = bend * (of_u - prior * of_p), -prior * bend * of_p
        pull = down + up if negative >= 0 else -down
        slope = np.append(np.bincount(col, pull[row], k) + decay * w, pull.sum())
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        move = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def chosen_features(in_p: np.ndarray, in_u: np.ndarray, p: int, u: int, prior: float, features: int) -> np.ndarray:
    """Features to learn from, sorted: by how surely they are commoner among ``p`` positives than ``u`` unlabelled texts."""
    of_p, of_u = in_p / p, (in_u + 0.5) / u
    sure = (of_p - of_u) / np.sqrt(np.maximum(of_u * (1 - np.minimum(of_u, 0.999)) / p, 1e-12))
    able = (in_p >= 5) & (sure > 3) & (prior * of_p > 0.3 * of_u)
    best = np.argsort(np.where(able, -sure, 0), kind="stable")[:features]
    return np.sort(best[able[best]])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, fold: int = 4, held_out: int = 2, most: int = 16_000, features: int = 4096) -> Model:
    """A model from confirmed toxic rows of ``labels`` and documents without a label, both outside the held-out fold.

    Where there are fewer of the latter than of the former, any documents outside the
    fold are the unlabelled ones, whatever their labels.  ``most`` bounds either
    sample; the driver gets, of each document, the chosen features only.  Of several
    labels of a doc_id the greatest counts, of several texts the least.  Rows without
    doc_id are not read.  Without positives or without other documents the model
    knows nothing and every score is the prior (0 without labels).
    """
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null")
    outside = F.crc32(F.col("doc_id").cast("string")) % fold != held_out
    free = seen.where("toxic is not null").where(outside).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = free.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("p")).first()
    if prior is None:
        prior = total["p"] / total["n"] if total["n"] else 0.0
    none = Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((prior + 1e-9) / (1 - prior + 1e-9))))
    if not 0 < prior < 1 or not total["p"]:
        return none

    def sample(ids: DataFrame, toxic: int) -> DataFrame:
        return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.lit(toxic).alias("toxic"))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    others = texts.where(outside).select("doc_id").distinct()
    positive = saved(sample(free.where("toxic = 1"), 1), "positive")
    plain = saved(sample(others.join(seen.select("doc_id"), "doc_id", "left_anti"), 0), "unlabelled")
    if plain.count() < positive.count():
        plain = saved(sample(others.join(positive, "doc_id", "left_anti"), 0), "unlabelled")
    rows = texts.join(F.broadcast(positive.union(plain)), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    rows = saved(rows.select("toxic", "text"), "training")

    def cells(batch):
        toxic = batch.column("toxic").to_numpy()
        for lo, n, row, feature in _features(batch.column("text")):
            yield feature + SPACE * (toxic[lo : lo + n][row] == 1)

    counts = summed(rows, 2 * SPACE, cells)
    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("p")).first()
    n, p = sizes["n"], sizes["p"]
    if not p or p == n:
        return none
    chosen = chosen_features(counts[SPACE:], counts[:SPACE], p, n - p, prior, features)
    if not len(chosen):
        return none
    asked = Model(chosen, np.zeros(len(chosen)), 0.0)

    def hold(batches):
        wanted = asked.wanted()
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for lo, n, row, feature in _features(batch.column("text"), wanted):
                cuts = np.searchsorted(row, np.arange(n + 1))
                at = np.searchsorted(chosen, feature).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(toxic[lo : lo + n].astype(np.int32)), pa.array([at[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["toxic", "features"])

    got = rows.mapInArrow(hold, "toxic int, features binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    cols = [np.frombuffer(bytes(r[1]), np.int32) for r in got]
    row = np.repeat(np.arange(len(got)), [len(c) for c in cols])
    w, b = fit_nnpu(row, np.concatenate(cols), np.array([r[0] == 1 for r in got]), len(chosen), prior)
    return Model(chosen, w, b)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, fold: int = 4, held_out: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null and empty texts have no features: their score is that of the bias.  A
    null doc_id is in no fold (held_out false).
    """

    def run(batches):
        wanted = model.wanted()
        for batch in batches:
            for lo, n, row, feature in _features(batch.column("text"), wanted):
                s = model.scores(n, row, feature)
                ids = batch.column("doc_id").slice(lo, n)
                out = [i is not None and zlib.crc32(str(i).encode()) % fold == held_out for i in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, pa.array(out), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay.

    A null or empty text has the score of the bias.  Repeated rows stay or go
    together; an empty table gives an empty result.
    """
    at = docs.columns.index("text")

    def run(batches):
        wanted = model.wanted()
        for batch in batches:
            for lo, n, row, feature in _features(batch.column(at), wanted):
                yield batch.slice(lo, n).filter(pa.array(model.scores(n, row, feature) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``; repeated rows are scored each."""
    return scored(docs, train(docs, labels), threshold)
