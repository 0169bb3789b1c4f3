"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, A-Z folded. Features are the distinct
words, pairs of neighbours, pairs with one word between them, and the first
PREFIXES bytes of words (inflected and compound forms), hashed to 2**BITS
coordinates. Each coordinate has a learning rate of its own and the
L1 term keeps only coordinates that pay, so the weights are a few thousand
numbers and are broadcast whatever the size of the corpus.

Learning takes at most SAMPLE labelled documents of each label (a documented
bound, drawn by a hash of the id) in one task; scoring reads every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import kernels as K
from .common import mapped, remainder

BITS = 20
#: Labelled documents of each label that learning may take.
SAMPLE = 3000
PREFIXES = (4, 5, 6, 7, 8)
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.1, 8


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of the distinct words, bigrams, skip-grams and prefixes, sorted."""
    starts, ends, doc = K.words(data, offsets, K.PUNCT)
    text = K.Text(data)
    h = text.ranges(starts, ends)
    docs, hashes = [doc], [h]
    for gap in (1, 2):
        pair = K.chained(h, [0, gap]) + np.uint64(gap)
        same = doc[: len(pair)] == doc[len(h) - len(pair) :] if len(pair) else np.zeros(0, bool)
        docs.append(doc[: len(pair)][same])
        hashes.append(pair[same])
    for size in PREFIXES:
        long = ends - starts >= size
        docs.append(doc[long])
        hashes.append(text.ranges(starts[long], starts[long] + size) + np.uint64(size + 16))
    where = (K.mix(np.concatenate(hashes)) >> np.uint64(64 - bits)).astype(np.int64)
    both = np.unique((np.concatenate(docs) << bits) | where)
    return both >> bits, both & ((1 << bits) - 1)


def ftrl(examples: list[np.ndarray], labels: list[int], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias): the coordinates whose weight is not zero."""
    z, n, bias_z, bias_n = np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at = examples[k]
            w = weights(at)
            bias = -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - labels[k]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
            step = ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA
            bias_z += g - step * bias
            bias_n += g * g
    used = np.flatnonzero(np.abs(z) > L1)
    return used, weights(used), -bias_z / ((BETA + bias_n**0.5) / ALPHA)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, allowed: Column, per_label: int) -> DataFrame:
    """(text, label) of at most ``per_label`` labelled documents of each label, drawn by a hash of the id; of unlike labels of one document the smaller counts."""
    marked = labels.where(allowed & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    drawn = [marked.where(F.col("label") == x).orderBy(F.xxhash64("_id"), "_id").limit(per_label) for x in (0, 1)]
    sample = F.broadcast(drawn[0].union(drawn[1]))  # 2 * per_label rows at most
    found = documents.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("_id")).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    return found.limit(2 * per_label).select(F.coalesce("text", F.lit("")).alias("text"), "label")


def train(documents: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", per_label: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from labelled rows for which ``allowed`` (a condition on labels) holds. Without them, all are zero and the bias is -35."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, marks = [], []
        for batch in batches:
            y = batch.column("label").to_pylist()
            for i, j, data, offsets in K.slices(batch.column("text")):
                doc, at = features(data, offsets)
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                examples += [at[cuts[k] : cuts[k + 1]] for k in range(j - i)]
                marks += y[i:j]
        if examples:
            at, w, bias = ftrl(examples, marks)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[bias, w])], names=["at", "weight"])

    sample = labelled_sample(documents, labels, label, allowed, per_label)
    rows = mapped(sample.coalesce(1), run, "at long, weight double").collect()
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0), -35.0
    at, w = np.array([r["at"] for r in rows]), np.array([r["weight"] for r in rows])
    return at[1:], w[1:], float(w[0])


def scores(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, float], row: Column) -> DataFrame:
    """``row`` (a struct of the document's columns) and a ``score`` from 0 to 1; a null or empty text gets the bias alone."""
    at, w, bias = model
    sent = documents.sparkSession.sparkContext.broadcast((at, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS)
        table[sent.value[0]] = sent.value[1]
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, data, offsets in K.slices(batch.column("text")):
                doc, where = features(data, offsets)
                out[i:j] = np.bincount(doc, table[where], j - i)
            score = 1 / (1 + np.exp(-np.clip(out + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score)], names=["row", "score"])

    given = documents.select(row.alias("row"), "text")
    return mapped(given, run, StructType([given.schema["row"], StructField("score", DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Rows whose crc32(doc_id) mod ``modulus`` is ``held`` are never learnt
    from. A null doc_id counts as empty text there. Repeated rows get equal
    scores; labels of unknown documents, null labels teach nothing, and of unlike labels of a document
    the smaller counts.
    """
    model = train(documents, labels, remainder("doc_id", modulus) != held)
    out = scores(documents, model, F.struct("doc_id")).select("row.doc_id", "score")
    return out.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that score under ``threshold``, with all their columns; learnt from all labelled rows."""
    model = train(documents, labels, F.lit(True))
    return scores(documents, model, F.struct("*")).where(F.col("score") < threshold).select("row.*")
