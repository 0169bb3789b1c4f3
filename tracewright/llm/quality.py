"""Quality: Bradley-Terry ranking of documents from preference pairs.

Each text becomes a short vector of counts and rates taken from its bytes and
words. A pair prefers a document of label 1 to one of label 0; the score is
linear and is learnt by logistic loss on the difference of the two vectors.
The cut is a quantile of the learning documents' scores: the one that divides
the two labels best. Scores are carried to 0..1 so that the cut lies at 0.3.

Learning takes at most SAMPLE labelled documents of each label (a documented
bound, drawn by a hash of the id) in one task; scoring reads every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import mapped, remainder
from .toxicity import labelled_sample

SAMPLE, PAIRS, STEPS, RIDGE, CUT = 3000, 60_000, 400, 1e-3, 0.3
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CLASSES = {
    "upper": [*range(65, 91)], "digit": [*range(48, 58)], "space": [32, *range(9, 14)], "line": [10], "stop": [46, 44], "shout": [33, 63],
    "mark": [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 96, 126], "bar": [124, 47, 92], "bracket": [40, 41, 91, 93, 123, 125], "quote": [34, 39, 58, 59], "wide": [*range(128, 256)],
}


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row for each text; an empty text is all zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    per = lambda mask: np.bincount(doc[mask], minlength=n)
    total = np.maximum(size, 1)
    columns = []
    for codes in _CLASSES.values():
        table = np.zeros(256, bool)
        table[codes] = True
        columns.append(per(table[data]) / total)
    starts, ends, where = K.words(data, offsets, K.SPACE)
    h = K.Text(data).ranges(starts, ends)
    count = np.bincount(where, minlength=n)
    some = np.maximum(count, 1)
    length = np.bincount(where, ends - starts, n) / some
    spread = np.bincount(where, (ends - starts - length[where]) ** 2, n) / some
    short = np.bincount(where, (ends - starts) <= 3, n) / some
    plain = _LETTER[data[starts]] & _LETTER[data[ends - 1]] if len(starts) else np.zeros(0, bool)
    clean = np.bincount(where, plain, n) / some
    order = np.lexsort((h, where))
    new = np.r_[True, (where[order][1:] != where[order][:-1]) | (h[order][1:] != h[order][:-1])] if len(h) else np.zeros(0, bool)
    distinct = np.bincount(where[order][new], minlength=n) / some
    pair = K.chained(h, [0, 1, 2, 3])
    same = where[: len(pair)] == where[len(h) - len(pair) :] if len(pair) else np.zeros(0, bool)
    pd, ph = where[: len(pair)][same], pair[same]
    order = np.lexsort((ph, pd))
    new = np.r_[True, (pd[order][1:] != pd[order][:-1]) | (ph[order][1:] != ph[order][:-1])] if len(ph) else np.zeros(0, bool)
    fours = np.bincount(pd, minlength=n)
    repeated = np.where(fours > 0, 1 - np.bincount(pd[order][new], minlength=n) / np.maximum(fours, 1), 0.0)
    columns += [np.minimum(length, 40) / 10, np.sqrt(np.minimum(spread, 400)) / 10, short, clean, distinct, repeated, np.log1p(count) / 10, np.minimum(count, 20) / 20, distinct * np.log1p(count) / 10]
    x = np.stack(columns, 1)
    x[size == 0] = 0
    return np.concatenate([x, np.sqrt(np.abs(x))], 1)


def bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS) -> tuple[np.ndarray, float, float]:
    """(weights, cut, scale): score = weights . x; the cut is the quantile that divides the labels best."""
    spread = x.std(0) + 1e-6
    z = x / spread
    rng = np.random.default_rng(11)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    difference = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, STEPS + 1):  # full-batch Adam on the logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(difference @ w, -35, 35)))
        g = -(difference * p[:, None]).mean(0) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = z @ w
    quantiles = np.quantile(s, np.linspace(0, 1, 401))
    right = [((s[good] >= c).mean() + (s[bad] < c).mean(), c) for c in quantiles]
    best = max(r for r, _ in right)
    cut = float(np.mean([c for r, c in right if r >= best - 1e-9]))
    return w / spread, cut, float(1 / max(np.abs(s - cut).mean() / 2, 1e-6))


def train(documents: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", per_label: int = SAMPLE) -> tuple[np.ndarray, float, float] | None:
    """The model, or None where a label has no document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys = [], []
        for batch in batches:
            ys.append(batch.column("label").to_numpy())
            xs += [vectors(data, offsets) for _, _, data, offsets in K.slices(batch.column("text"))]
        if ys and len(np.unique(np.concatenate(ys))) == 2:
            w, cut, scale = bradley_terry(np.concatenate(xs), np.concatenate(ys))
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()]), pa.array([cut]), pa.array([scale])], names=["w", "cut", "scale"])

    sample = labelled_sample(documents, labels, label, allowed, per_label)
    row = mapped(sample.coalesce(1), run, "w array<double>, cut double, scale double").first()
    return None if row is None else (np.array(row["w"]), row["cut"], row["scale"])


def scores(documents: DataFrame, model: tuple[np.ndarray, float, float] | None) -> DataFrame:
    """doc_id and a ``score`` from 0 to 1, 0.3 at the cut; without a model, every score is 0.5."""
    odds = float(np.log(CUT / (1 - CUT)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, 0.5)
            if model is not None:
                w, cut, scale = model
                for i, j, data, offsets in K.slices(batch.column("text")):
                    out[i:j] = 1 / (1 + np.exp(-np.clip((vectors(data, offsets) @ w - cut) * scale + odds, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return mapped(documents.select("doc_id", "text"), run, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Rows whose crc32(doc_id) mod ``modulus`` is ``held`` are never learnt
    from; a null doc_id counts as empty text there. A null text is the empty
    text and gets a score like any other. Where a label has no document to
    learn from there is no model: every score is 0.5, every prediction 1.
    """
    model = train(documents, labels, remainder("doc_id", modulus) != held)
    out = scores(documents, model)
    return out.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
