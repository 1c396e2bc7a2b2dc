"""Toxicity by a classifier chain: categories in order, each model fed with the earlier ones' probabilities.

Features are the distinct words of the whole text (letter runs, ASCII folded, hashed), scaled by their
naive-Bayes log ratio; each category's model is a linear one (logistic regression). Later models train
on out-of-fold probabilities of the earlier categories, so they see them as noisy as in prediction.

Fitting takes a bounded sample of labelled rows (``sample_docs``, by hash of the id); its features meet
in one task. Prediction is one narrow map over whole texts with a model of at most ``most_features``
weights a category. The decision threshold is the one with the best F1 of
out-of-fold probabilities, 0.5 at least.

Null or empty text: probability 0, not toxic. Missing labels are left out of the fit of their
category; a category with one class only predicts its rate. Repeated labels of an id: the largest
holds; of documents that repeat an id, the smallest text is learned from. Repeated documents each get their row; an empty table gives an empty one; other columns are
not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, kept_rows, output
from .unit_encoder import _bytes_of

BATCH_BYTES = 4_000_000
#: Bounds of the fit: labelled rows, hashed features kept a category, folds.
SAMPLE_DOCS, MOST_FEATURES, FOLDS, HASH_BITS = 8000, 4000, 3, 20

_FOLD = np.zeros(256, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def words(texts: pa.Array, hash_bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed word), each pair once, by document."""
    raw, offsets = _bytes_of(texts)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = _FOLD[raw]
    letter = raw > 0
    cuts = np.zeros(len(raw), bool)
    cuts[1:] = letter[1:] != letter[:-1]
    cuts[offsets[(offsets > 0) & (offsets < len(raw))]] = True
    cuts[0] = True
    starts = np.flatnonzero(cuts)
    units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    low = (1 << hash_bits) - 1
    hashed = np.fromiter((zlib.crc32(w) & low if w[0] else -1 for w in units.dictionary.to_pylist()), np.int64)
    feature = hashed[units.indices.to_numpy()]
    doc = np.searchsorted(offsets, starts, side="right") - 1
    pair = np.unique((doc << hash_bits | feature)[feature >= 0])
    return pair >> hash_bits, pair & low


@dataclass
class Link:
    """One category of the chain: hashed features in order, their weights, the weights of earlier categories' logits, and the intercept."""

    name: str
    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    intercept: float
    threshold: float = 0.5


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)
    hash_bits: int = HASH_BITS


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _fit(doc, feature, dense, y, most_features: int, l2: float = 1e-4, steps: int = 300) -> Link:
    """Logistic regression over present words times their log ratio, and dense columns, by accelerated gradient steps."""
    n, rate = len(y), float(y.mean()) if len(y) else 0.0
    none = np.zeros(0, np.int64)
    if not 0 < rate < 1:
        return Link("", none, np.zeros(0), np.zeros(dense.shape[1]), float(_logit(np.array(rate))))
    ids, at = np.unique(feature, return_inverse=True)
    df = np.bincount(at)
    pos = np.bincount(at, weights=y[doc])
    ratio = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((df - pos + 0.5) / (n - y.sum() + 1))
    worth = np.abs(ratio) * np.sqrt(df) * (df >= 3)
    chosen = np.sort(np.argsort(-worth, kind="stable")[:most_features])
    chosen = chosen[worth[chosen] > 0]
    column = np.full(len(ids), -1)
    column[chosen] = np.arange(len(chosen))
    keep = column[at] >= 0
    d, c = doc[keep], column[at][keep]
    scale = ratio[chosen]
    w, v, b = np.zeros(len(chosen)), np.zeros(dense.shape[1]), float(_logit(np.array(rate)))
    sq = np.bincount(d, weights=scale[c] ** 2, minlength=n) + (dense**2).sum(axis=1) + 1
    step = 4 / sq.mean()  # the loss's curvature is at most a quarter of this mean
    old = (w, v, b)
    for k in range(steps):
        m = k / (k + 3)
        u, x, t = (a + m * (a - o) for a, o in zip((w, v, b), old, strict=True))
        r = (_sigmoid(np.bincount(d, weights=(u * scale)[c], minlength=n) + dense @ x + t) - y) / n
        old = (w, v, b)
        w = u - step * (np.bincount(c, weights=r[d], minlength=len(u)) * scale + l2 * u)
        v = x - step * (dense.T @ r + l2 * x)
        b = t - step * r.sum()
    return Link("", ids[chosen], w * scale, v, float(b))


def _apply(link: Link, doc, feature, dense, n: int) -> np.ndarray:
    z = np.full(n, link.intercept) + (dense @ link.earlier if dense.shape[1] else 0)
    if len(link.features) and len(feature):
        at = np.minimum(np.searchsorted(link.features, feature), len(link.features) - 1)
        z += np.bincount(doc, weights=np.where(link.features[at] == feature, link.weights[at], 0.0), minlength=n)
    return _sigmoid(z)


def fit_chain(doc, feature, labels: dict[str, np.ndarray], folds: np.ndarray, most_features: int) -> list[Link]:
    """Links in the labels' order; labels hold 0, 1 or nan."""
    n = len(folds)
    dense, links = np.zeros((n, 0)), []

    def part(rows):
        place = np.cumsum(rows) - 1
        keep = rows[doc]
        return place[doc[keep]], feature[keep]

    for name, y in labels.items():
        own = ~np.isnan(y)
        guess = np.zeros(n)
        for k in range(int(folds.max()) + 1 if n else 0):
            rows, rest = own & (folds != k), folds == k
            link = _fit(*part(rows), dense[rows], y[rows], most_features)
            guess[rest] = _apply(link, *part(rest), dense[rest], int(rest.sum()))
        link = _fit(*part(own), dense[own], y[own], most_features)
        link.name, link.threshold = name, best_threshold(guess[own], y[own])
        links.append(link)
        dense = np.column_stack([dense, _logit(guess)])
    return links


def best_threshold(p: np.ndarray, y: np.ndarray, least: float = 0.5) -> float:
    """The middle of the gap at which F1 is best, of those from ``least`` on; 0.5 if there is nothing to choose."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    last = np.append(p[1:] != p[:-1], True)
    hit = np.cumsum(y)
    f1 = np.where(last, 2 * hit / (np.arange(1, len(y) + 1) + y.sum()), -1)
    k = int(np.where(p >= least, f1, -1).argmax())
    return float(max(least, (p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2))


def train(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, most_features: int = MOST_FEATURES, folds: int = FOLDS) -> Chain:
    """Fits the chain on a bounded sample; categories: 0/1 columns of labels, or SQL expressions ``name=expression``, in chain order."""
    pairs = [c.split("=", 1) if "=" in c else [c, c] for c in categories]
    names = [p[0] for p in pairs]
    own = labels.select(F.col(id_col).cast("long").alias("key"), *[F.expr(e).cast("double").alias(f"y{i}") for i, (_, e) in enumerate(pairs)]).where("key IS NOT NULL")
    own = own.groupBy("key").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(pairs))])
    share = min(1.0, sample_docs / max(1, own.count()))
    own = own.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("text")).where("key IS NOT NULL AND text IS NOT NULL")
    # bounded by the sampled ids: of rows that repeat one, the smallest text is learned from
    rows = texts.join(F.broadcast(own), "key").groupBy("key", *[f"y{i}" for i in range(len(pairs))]).agg(F.min("text").alias("text"))
    y_fields = [(f"y{i}", pa.float64()) for i in range(len(pairs))]
    schema = pa.schema([("key", pa.int64()), *y_fields, ("words", pa.list_(pa.int32()))])

    def featured(batches):
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            doc, feature = words(batch.column("text"))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))
            yield output(schema, [batch.column("key"), *[batch.column(n) for n, _ in y_fields], lists])

    spec = ", ".join(f"{n} double" for n, _ in y_fields)
    sample = rows.select("key", *[n for n, _ in y_fields], "text").mapInArrow(featured, f"key long, {spec}, words array<int>")

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable").reset_index(drop=True)
        doc = np.repeat(np.arange(len(rows)), rows["words"].map(len))
        feature = np.concatenate([np.zeros(0, np.int64), *[np.asarray(w, np.int64) for w in rows["words"]]])
        fold = np.asarray([zlib.crc32(str(k).encode()) % folds for k in rows["key"]])
        links = fit_chain(doc, feature, {n: rows[f"y{i}"].to_numpy(np.float64) for i, n in enumerate(names)}, fold, most_features)
        return pd.DataFrame([(k, x.features.tolist(), x.weights.tolist(), x.earlier.tolist(), x.intercept, x.threshold) for k, x in enumerate(links)], columns=["k", "features", "weights", "earlier", "intercept", "threshold"])

    out = sample.groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: fitted(pdf), "k int, features array<long>, weights array<double>, earlier array<double>, intercept double, threshold double")
    links = [Link(names[r.k], np.asarray(r.features, np.int64), np.asarray(r.weights), np.asarray(r.earlier), r.intercept, r.threshold) for r in sorted(out.collect(), key=lambda r: r.k)]
    if not links:  # nothing to learn from: every category has rate 0
        nothing = np.zeros(0, np.int64)
        links = [Link(n, nothing, np.zeros(0), np.zeros(k), float(_logit(np.array(0.0)))) for k, n in enumerate(names)]
    return Chain(links)


def probabilities(texts: pa.Array, chain: Chain) -> list[np.ndarray]:
    """Of each category in chain order, the texts' probabilities; 0 for a text without words."""
    doc, feature = words(texts, chain.hash_bits)
    n = len(texts)
    some = np.bincount(doc, minlength=n) > 0
    dense, out = np.zeros((n, 0)), []
    for link in chain.links:
        p = _apply(link, doc, feature, dense, n)
        dense = np.column_stack([dense, _logit(p)])
        out.append(np.where(some, p, 0.0))
    return out


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category> of each category in chain order)."""
    names = [f"p_{x.name}" for x in chain.links]
    schema = pa.schema([("key", pa.int64()), *[(n, pa.float64()) for n in names]])
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def scored(batches):
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            yield output(schema, [batch.column("key"), *probabilities(batch.column("text"), shared.value)])

    rows = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(scored, ", ".join(["key long", *[f"{n} double" for n in names]])).withColumnRenamed("key", id_col)


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The documents below the last category's threshold, with all their columns."""
    if not chain.links:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def below(texts: pa.Array) -> np.ndarray:
        last = shared.value.links[-1]
        return probabilities(texts, shared.value)[-1] < last.threshold

    return kept_rows(docs, text_col, below, BATCH_BYTES)
