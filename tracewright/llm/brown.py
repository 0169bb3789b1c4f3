"""Language-model scores from a class-based bigram model (Brown clustering by exchange).

Every word of the learning documents has one of CLASSES classes. The M most
frequent words are clustered by exchange: units move between classes while the
likelihood of the class bigrams rises. The FREQUENT commonest words, and after
them all others down to those seen once, take the class that is best given the
classes of the words beside them, gathered for each word over all learning
documents. A word's probability is P(class | class before) * P(word | class),
with every class keeping a share for words never seen; such a word has the
class that most words seen once have.

Only tables with fixed bounds are broadcast: the bigrams of the M words and of
the classes, and the FREQUENT commonest words. Counts and classes of all other
words are a distributed table that grows with the vocabulary and meets the
documents in a shuffled join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed, mapped

M, CLASSES, PASSES = 600, 48, 8
FREQUENT = 300_000
ADD, BACK_OFF = 0.1, 5.0
#: The hash that stands for the end of a text.
END = int(K.seeds(1, 424242)[0].astype(np.int64))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each text's words and, last, its end."""
    n = len(offsets) - 1
    starts, ends, doc = K.words(data, offsets, K.SPACE)
    h = K.Text(data).ranges(starts, ends).view(np.int64)
    order = np.argsort(np.concatenate([doc, np.arange(n)]), kind="stable")
    return np.concatenate([doc, np.arange(n)])[order], np.concatenate([h, np.full(n, END)])[order]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        return h[start], np.add.reduceat(c, start)

    size = 0
    for batch in batches:
        for _, _, data, offsets in K.slices(batch.column("text")):
            held.append(np.unique(tokens(data, offsets)[1], return_counts=True))
            size += len(held[-1][0])
            if size > 3_000_000:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["h", "c"])
                    held.clear()
                    size = 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["h", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, c): hash and count of each distinct token of ``texts`` (text)."""
    return mapped(texts, _counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Known:
    """Numbers of the tokens ``h``, which must hold the end; any other token has the number ``other``."""

    def __init__(self, h: np.ndarray, number: np.ndarray, other: int):
        order = np.argsort(h)
        self.h, self.number, self.other = h[order], number[order], other

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return at, self.h[at] == h

    def of(self, h: np.ndarray) -> np.ndarray:
        at, found = self.find(h)
        return np.where(found, self.number[at], self.other)


def bigrams(texts: DataFrame, known: Known, n: int) -> np.ndarray:
    """Bigram counts of ``known``'s ``n`` numbers over all texts; a text starts after an end."""
    end = known.of(np.array([END]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, np.int64)
        for batch in batches:
            for _, _, data, offsets in K.slices(batch.column("text")):
                u = known.of(tokens(data, offsets)[1])
                before = np.r_[end, u[:-1]]  # the token before a text's first is the end of the one before
                total += np.bincount(before * n + u, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return _gathered(mapped(texts, run, "pair long, n long"), n)


def _gathered(parts: DataFrame, n: int) -> np.ndarray:
    rows = parts.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n * n)
    out[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(n, n)


def assigned(texts: DataFrame, known: Known, table: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """(h, cls): the best class of each word of ``texts`` outside ``known`` (and within the sorted ``wanted``).

    ``known`` has classes, the number after them standing for all other
    words, and ``table`` the bigrams of these numbers. A word's class is the
    one in which its bigrams with the classes beside it are likeliest. Counts
    by word and neighbours are summed in each task, then by word.
    """
    n = len(table)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> pa.RecordBatch:
            h, x = (np.concatenate(p) for p in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((x, h))
            h, x = h[order], x[order]
            start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])])
            return pa.RecordBatch.from_arrays([pa.array(h[start]), pa.array(x[start]), pa.array(np.diff(np.r_[start, len(h)]).astype(np.int32))], names=["h", "x", "n"])

        size = 0
        for batch in batches:
            for _, _, data, offsets in K.slices(batch.column("text")):
                h = tokens(data, offsets)[1]
                c = known.of(h)
                at = np.flatnonzero(c == known.other)  # never a text's end
                if wanted is not None and len(at):
                    at = at[wanted[np.minimum(np.searchsorted(wanted, h[at]), len(wanted) - 1)] == h[at]]
                if not len(at):
                    continue
                before = np.r_[known.of(np.array([END])), c[:-1]]
                held.append((h[at], (before[at] * n + c[at + 1]).astype(np.int32)))
                size += len(at)
                if size > 2_000_000:
                    yield summed()
                    size = 0
        if held:
            yield summed()

    log = np.log(table + ADD)
    share = np.log(table.sum(1) + ADD * n) + np.log(table.sum(0) + ADD * n)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            x, times = (near.flatten().field(f).to_numpy().astype(np.int64) for f in ("x", "n"))
            word, m = np.repeat(np.arange(len(near)), np.diff(near.offsets.to_numpy())), len(near)
            left = np.bincount(word * n + x // n, times, m * n).reshape(m, n)
            right = np.bincount(word * n + x % n, times, m * n).reshape(m, n)
            gain = left @ log + right @ log.T - left.sum(1)[:, None] * share[None, :]
            # neither the end's class nor the number of the words without one
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array((gain[:, 1:-1].argmax(1) + 1).astype(np.int32))], names=["h", "cls"])

    # Summed by (word, neighbours) first: a word that every task has is then one row of n * n pairs at most.
    near = mapped(texts, gather, "h long, x int, n int").groupBy("h", "x").agg(F.sum("n").cast("int").alias("n")).groupBy("h").agg(F.collect_list(F.struct("x", "n")).alias("near"))
    return mapped(near, choose, "h long, cls int")


def exchange(counts: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each unit; the last unit (the end) keeps class 0 to itself.

    Each step takes a unit out of its class and puts it where the sum of
    n log n over class bigrams, less that over class counts before and after,
    is largest.
    """
    n = len(counts)
    k = min(classes, n)
    weight = counts.sum(0) + counts.sum(1)
    cls = np.zeros(n, np.int64)
    order = np.argsort(-weight[: n - 1], kind="stable")
    cls[order] = np.arange(n - 1) % max(k - 1, 1) + 1 if k > 1 else 0
    if k <= 2:
        return cls
    member = np.eye(k)[cls]
    table = member.T @ counts @ member
    f = lambda x: x * np.log(np.maximum(x, 1))
    for _ in range(passes):
        moved = 0
        for u in order:
            if not weight[u]:
                continue
            old = cls[u]
            self_ = counts[u, u]
            out_ = np.bincount(cls, counts[u], k)
            out_[old] -= self_
            in_ = np.bincount(cls, counts[:, u], k)
            in_[old] -= self_
            table[old, :] -= out_
            table[:, old] -= in_
            table[old, old] -= self_
            # gain of class c: row c grows by out_, column c by in_, the corner by all and the self bigrams
            rows = (f(table + out_[None, :]) - f(table)).sum(1)
            cols = (f(table + in_[:, None]) - f(table)).sum(0)
            d = np.arange(k)
            corner = table[d, d]
            both = f(corner + out_ + in_ + self_) - f(corner + out_) - f(corner + in_) + f(corner)
            before, after = table.sum(1) + in_, table.sum(0) + out_
            gain = rows + cols + both - f(before + out_.sum() + self_) + f(before) - f(after + in_.sum() + self_) + f(after)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            table[new, :] += out_
            table[:, new] += in_
            table[new, new] += self_
            cls[u] = new
            moved += new != old
        if not moved:
            break
    return cls


def transitions_of(table: np.ndarray) -> np.ndarray:
    """P(class | class before) from bigram counts: it backs off to the class's own share, which backs off to equal shares."""
    own = (table.sum(0) + ADD) / (table.sum() + ADD * len(table))
    return (table + BACK_OFF * own[None, :]) / (table.sum(1, keepdims=True) + BACK_OFF)


def score(documents: DataFrame, allowed: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row; learnt from rows for which ``allowed`` holds.

    A null text is empty: its only token is the end. Repeated rows are scored
    alike. Without learning documents every count is zero, each word has the
    same probability, and both scores follow from the smoothing alone.
    """
    texts = documents.where(allowed).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = checkpointed(word_counts(texts))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = counts.where(F.col("h") != END)
    n_end = total - words.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    # The commonest words, by whole steps of a sixteenth of a doubling: as many steps as hold FREQUENT words at most.
    step = F.floor(F.log2("c") * 16)
    sizes = {r["s"]: r["n"] for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}
    least, room = max(sizes, default=0) + 1, FREQUENT
    for s in sorted(sizes, reverse=True):
        if sizes[s] > room:
            break
        least, room = s, room - sizes[s]
    common = step >= least
    if sizes and least > max(sizes):  # more words than FREQUENT share the highest step: the first ones by count and hash
        edge = words.orderBy(F.col("c").desc(), "h").limit(FREQUENT).agg(F.min(F.struct("c", (-F.col("h")).alias("h"))).alias("x")).first()["x"]
        common = (F.col("c") > edge["c"]) | ((F.col("c") == edge["c"]) & (F.col("h") <= -edge["h"]))
    top = words.where(common).toPandas().sort_values(["c", "h"], ascending=[False, True])
    top_h, top_c = top["h"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    # The M commonest by exchange; all other words are one unit meanwhile.
    m = min(M, len(top_h))
    pairs = bigrams(texts, Known(np.r_[top_h[:m], END], np.r_[np.arange(m), m + 1], m), m + 2)
    units = exchange(pairs)
    k = int(units.max()) + 1
    units[m] = k
    member = np.eye(k + 1)[units]
    top_cls = units[:m]
    if len(top_h) > m:
        found = assigned(texts, Known(np.r_[top_h[:m], END], np.r_[top_cls, 0], k), member.T @ pairs @ member, np.sort(top_h[m:])).toPandas()
        top_cls = np.r_[top_cls, found.set_index("h")["cls"].reindex(top_h[m:]).to_numpy(np.int64)]
    known = Known(np.r_[top_h, END], np.r_[top_cls, 0], k)
    tail = words.where(~common)
    if distinct - (n_end > 0) > len(top_h):
        tail = tail.join(assigned(texts, known, bigrams(texts, known, k + 1)), "h")
    else:
        tail = tail.withColumn("cls", F.lit(None).cast("int"))
    tail = checkpointed(tail.select("h", "c", "cls"))
    sums = tail.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).toPandas()
    of = lambda c: np.bincount(sums["cls"].to_numpy(np.int64), sums[c].to_numpy(float), k)
    class_n, class_v = np.bincount(top_cls, top_c, k) + of("c"), np.bincount(top_cls, minlength=k) + of("v")
    class_n[0], class_v[0] = n_end, n_end > 0
    unseen = int((np.bincount(top_cls, top_c == 1, k) + of("once"))[1:].argmax()) + 1
    below = np.log10(class_n + ADD * (class_v + 1))
    order = np.argsort(np.r_[top_h, END])
    model = documents.sparkSession.sparkContext.broadcast((known, np.log10(np.r_[top_c, n_end] + ADD)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_log = model.value
        for batch in batches:
            for i, j, data, offsets in K.slices(batch.column("text")):
                doc, h = tokens(data, offsets)
                n = j - i
                at, found = known.find(h)
                seen = found & (n_end > 0) | found & (h != END)
                cuts = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
                seq = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(cuts), pa.py_buffer(np.where(found, known.number[at], k).astype(np.uint8))])
                rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[~found], np.arange(n + 1)).astype(np.int32)), pa.array(h[~found]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), batch.column("learn").slice(i, n), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, seen, n).astype(np.int64)), pa.array(np.bincount(doc, np.where(found, known_log[at], 0.0), n)), seq, rare],
                    names=["doc_id", "learn", "n_tokens", "n_known", "above", "seq", "rare"],
                )

    # A byte a token: its class, or k where the class comes from the join.
    scored = mapped(documents.select("doc_id", F.coalesce(allowed, F.lit(False)).alias("learn"), "text"), run, "doc_id long, learn boolean, n_tokens long, n_known long, above double, seq binary, rare array<long>")
    scored = checkpointed(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.posexplode("rare").alias("pos", "h"))
    met = rare.join(tail, "h", "left").select("row", "pos", F.coalesce("cls", F.lit(unseen)).alias("cls"), F.coalesce("c", F.lit(0)).alias("n"))
    extra = met.groupBy("row").agg(F.sum(F.log10(F.col("n") + ADD)).alias("rare_above"), F.count_if(F.col("n") > 0).alias("rare_known"), F.array_sort(F.collect_list(F.struct("pos", F.col("cls").cast("byte").alias("cls")))).alias("met"))
    extra = extra.withColumn("met", F.col("met.cls"))
    whole = checkpointed(scored.drop("rare").join(extra, "row", "left"))

    def classes(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, text, class before, class) of a run of rows; a text starts after an end."""
        for i, j, data, offsets in K.slices(batch.column("seq")):
            c = data.astype(np.int64)
            c[c == k] = batch.column("met").slice(i, j - i).flatten().to_numpy()
            yield i, j, np.repeat(np.arange(j - i), np.diff(offsets)), np.r_[0, c[:-1]], c

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in batches:
            for _, _, _, before, c in classes(batch):
                total += np.bincount(before * k + c, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total)], names=["pair", "n"])

    table = _gathered(mapped(whole.where("learn").select("seq", "met"), transitions, "pair long, n long"), k)
    follow = np.log10(transitions_of(table))

    def shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, doc, before, c in classes(batch):
                shape = pa.array(np.bincount(doc, follow[before, c] - below[c], j - i))
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(i, j - i) for x in ("doc_id", "n_tokens", "n_known", "sum")), shape], names=["doc_id", "n_tokens", "n_known", "sum", "shape"])

    known_too = (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known")
    out = whole.select("doc_id", "n_tokens", known_too, (F.col("above") + F.coalesce("rare_above", F.lit(0.0))).alias("sum"), "seq", "met")
    out = mapped(out, shaped, "doc_id long, n_tokens long, n_known long, sum double, shape double")
    floor = float(np.log10(total + ADD * (distinct + 1)))
    return out.select(
        "doc_id", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("sum") - F.col("n_tokens") * floor).alias("base_score"), (F.col("sum") + F.col("shape")).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """A model's and the base's perplexity a token over all rows of ``score``'s result."""
    per = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
