"""Exact removal of repeated passages, by bucket-pointer refinement of suffixes.

The suffixes that matter start in a window of ``length`` bytes that some
other document holds too. Each window's least q-gram hash (an anchor) is the
same wherever the window occurs, so anchors of one document alone need no
sorting. The contexts of the others, what stands before and after an anchor,
meet by anchor, and there every suffix of the context gets a bucket: first by
its q-gram, then, pass by pass, buckets of two or more are split by the bucket
numbers of the suffixes at a later offset, and the new numbers serve the next
pass, which sees twice as far. Suffixes of ``length`` bytes in one bucket are
equal windows; the smallest doc_id of each decides what goes.

Cost: three scans of the texts; shuffles of a hash of four to six bytes for
each anchor (one in about ``(length - q) / 2`` bytes) and of the distinct
contexts of shared anchors. No task holds a whole class of equal windows:
every map task sends each distinct context once, with its smallest doc_id. An
anchor of many rows (a common short line) is split: windows that lie alike to
the anchor share bytes beside it, and those bytes deal them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from . import kernels as K
from .common import checkpointed, grouped, mapped, partitions, sized

GRAM = 26
#: Bits of the table of shared anchors, whose size is 2**BITS / 8 bytes whatever the input, and how many fewer that of common ones has.
BITS, FEWER = 28, 4
#: An anchor is common if one map task's share holds it in MANY rows or SHARES such shares hold it.
MANY, SHARES = 256, 1024
#: Bytes of text for each bucket of anchors, and contexts refined at once.
BUCKET, TOGETHER = 1 << 26, 1 << 14
#: Bytes of the initial buckets.
FIRST = 5
_LOW = np.uint64((1 << 48) - 1)


def numbered(keys: np.ndarray) -> np.ndarray:
    """The bucket of each key: how many keys are smaller."""
    order = np.argsort(keys)
    k = keys[order]
    start = np.r_[True, k[1:] != k[:-1]][: len(k)]
    out = np.empty(len(k), np.int64)
    out[order] = np.maximum.accumulate(np.where(start, np.arange(len(k)), 0))
    return out


def refine(buckets: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket numbers split by the bucket numbers at a later offset.

    A bucket's number is the count of suffixes in smaller buckets, so the
    parts of a bucket share out its numbers and all others stay as they are.
    Only suffixes in buckets of two or more are sorted.
    """
    open_ = np.flatnonzero(np.bincount(buckets, minlength=len(buckets) + 1)[buckets] > 1)
    if not len(open_):
        return buckets
    order = open_[np.argsort((buckets[open_] << 32) | later[open_])]
    b, x = buckets[order], later[order]
    whole = np.r_[True, b[1:] != b[:-1]]
    part = whole | np.r_[True, x[1:] != x[:-1]]
    place = np.arange(len(order))
    out = buckets.copy()
    out[order] = b + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(whole, place, 0))
    return out


def suffix_array(text: bytes) -> np.ndarray:
    """The starts of all suffixes of one text, sorted, by bucket-pointer refinement.

    The initial buckets are two bytes long; each pass doubles the length that
    bucket numbers stand for.
    """
    n, span = len(text), 2
    data = np.frombuffer(text, np.uint8).astype(np.int64) + 1
    rank = numbered(data * 257 + np.r_[data[1:], 0][:n])
    while len(np.unique(rank)) < n:
        rank = refine(rank, np.r_[rank[span:] + 1, np.zeros(min(span, n), np.int64)])
        span *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def window_buckets(anchor: np.ndarray, around: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray]]:
    """(r, buckets) for r from ``low`` to ``high``: equal buckets are equal windows with r bytes after the anchor.

    A row's text is the bytes before its anchor, the anchor, a symbol of its
    own, and as many bytes after it. Suffixes that start at one place of the
    row share one numbering; the window with r bytes after the anchor is the
    suffix at place r, cut where all windows end.
    """
    side = around.shape[1] // 2
    width = side + 1

    def first(p: int, q: int) -> np.ndarray:
        v = np.zeros(len(around), np.int64)
        for c in range(p, p + q):
            if c != side:
                v = (v << 8) | around[:, c - (c > side)]
        return numbered(v | (anchor << 32) if p <= side < p + q else v)

    span = min(FIRST, width)
    at = {p: first(p, span) for p in range(low, high + width - span + 1)}
    while span < width:
        step = min(span, width - span)
        at = {p: refine(at[p], at[p + step]) for p in range(low, high + width - span - step + 1)}
        span += step
    for r in range(low, high + 1):
        yield r, at[r]


def _anchors(data: np.ndarray, offsets: np.ndarray, text: K.Text, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the least q-grams of all windows of ``length`` bytes within a text."""
    w = length - q + 1
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(data) < length:
        return none
    h = text.grams(q)
    least = K.sliding(h, w)  # of the window that starts there
    sizes = np.diff(offsets)
    inside = np.zeros(len(data) + 1, np.int64)
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, (offsets[1:] - length + 1)[long], -1)
    valid = np.cumsum(inside)[: len(least)] > 0
    least = np.where(valid, least, np.uint64(0))  # no gram's hash is taken for 0
    pad = np.zeros(w - 1, np.uint64)
    most = K.sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    at = np.flatnonzero(most == h)
    return np.searchsorted(offsets, at, "right") - 1, at, h[at]


def _span(buckets: int, bits: int) -> int:
    """Slots of the bit table that a bucket holds: whole bytes in the table of common anchors too."""
    whole = 8 << FEWER
    return -(-(1 << bits) // (whole * buckets)) * whole


def _packed(h: np.ndarray) -> bytes:
    """Sorted 48-bit hashes: the first, then the steps, in as few bytes each as hold the largest."""
    if not len(h):
        return b""
    steps = np.diff(h, prepend=h[:1])
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return h[:1].tobytes() + bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return np.zeros(0, np.uint64)
    width = int(x[8])
    steps = np.zeros(((len(x) - 9) // width, 8), np.uint8)
    steps[:, :width] = x[9:].reshape(-1, width)
    return np.cumsum(steps.view(np.uint64).ravel()) + x[:8].copy().view(np.uint64)[0]


def _hashed(length: int, q: int, buckets: int, bits: int):
    """For each bucket, the sorted distinct anchor hashes of a share of the rows, those that two rows hold, and those that MANY do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            h = np.sort(np.concatenate(kept))
            kept.clear()
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            held, h = np.diff(np.r_[start, len(h)]), h[start]
            lists = h, h[held > 1], h[held >= MANY]
            cuts = (np.arange(buckets + 1, dtype=np.uint64) * np.uint64(_span(buckets, bits))) << np.uint64(48 - bits)
            ends = [np.searchsorted(x, cuts) for x in lists]
            some = np.flatnonzero(np.diff(ends[0]))
            columns = [pa.array([_packed(x[e[i] : e[i + 1]]) for i in some], pa.binary()) for x, e in zip(lists, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *columns], names=["bucket", "once", "twice", "many"])

        total = 0
        for batch in batches:
            for _, _, data, offsets in K.slices(batch.column("text")):
                doc, _, h = _anchors(data, offsets, K.Text(data, K.BYTE), length, q)
                h = h & _LOW
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
                kept.append(h[new])
                total += int(new.sum())
                if total > 2_500_000:
                    yield flush()
                    total = 0
        if total:
            yield flush()

    return run


def _shared(buckets: int, bits: int):
    """A bucket's part of the two bit tables: hashes that two shares or two rows hold, and common ones."""

    def run(table: pa.Table) -> pa.Table:
        lists = [[_unpacked(np.frombuffer(x.as_buffer(), np.uint8)) for x in table.column(c)] for c in ("once", "twice", "many")]
        h = np.sort(np.concatenate(lists[0]))
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        held, h = np.diff(np.r_[start, len(h)]), h[start]
        bucket, span = table.column("bucket")[0].as_py(), _span(buckets, bits)

        def part(hashes: list[np.ndarray], fewer: int) -> pa.Array:
            out = np.zeros(span >> fewer, bool)
            out[((np.concatenate(hashes) >> np.uint64(48 - bits)).astype(np.int64) - bucket * span) >> fewer] = True
            return pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())

        return pa.table({"bucket": pa.array([bucket], pa.int32()), "part": part([h[held > 1], *lists[1]], 0), "common": part([h[held >= SHARES], *lists[2]], FEWER)})

    return run


def _ranges(side: int) -> list[tuple[int, int]]:
    """Kinds of context: 0 serves all windows, the others those with so many bytes after the anchor, short ranges near the ends."""
    low = [0, *(x for x in (3 * (1 << k) // 2 for k in range(side.bit_length())) if 2 * x <= side + 1)]
    starts = sorted({*low, *(side + 1 - x for x in low if x)})
    return [(0, side), *zip(starts, [*(x - 1 for x in starts[1:]), side], strict=True)]


def _mixed(rows: np.ndarray, seed: int, *more: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes and of the numbers beside it."""
    n, width = rows.shape
    padded = np.zeros((n, max(8, -(-width // 8) * 8)), np.uint8)
    padded[:, :width] = rows
    wide = padded.view(np.uint64)
    columns = [*(x.astype(np.uint64) for x in more), *(wide[:, k] for k in range(wide.shape[1]))]
    out = np.zeros(n, np.uint64)
    for x, s in zip(columns, K.seeds(len(columns), seed), strict=True):
        out = K.mix((out + x) ^ s)
    return out


class Contexts:
    """Rows of anchors with their surroundings: a hash of the anchor of 64 and one of 32 bits, kind, bytes around, real bytes before and after."""

    FIELDS = ("h", "h2", "kind", "around", "before", "after")

    def __init__(self, *fields: np.ndarray):
        self.h, self.h2, self.kind, self.around, self.before, self.after = fields

    def __len__(self) -> int:
        return len(self.h)

    def take(self, at) -> Contexts:
        return Contexts(*(getattr(self, f)[at] for f in self.FIELDS))

    @classmethod
    def joined(cls, parts: list[Contexts]) -> Contexts:
        return cls(*(np.concatenate([getattr(p, f) for p in parts]) for f in cls.FIELDS))

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """A 128-bit name of each."""
        return tuple(_mixed(self.around, seed, self.h, self.h2, self.kind, self.before, self.after) for seed in (7001, 8001))

    def only(self, kind: int, low: int, high: int) -> tuple[Contexts, np.ndarray]:
        """What windows with ``low`` to ``high`` bytes after the anchor can see, and a hash of what all of them see."""
        side = self.around.shape[1] // 2
        around, column = self.around.copy(), np.arange(2 * side)
        around[:, (column < low) | (column >= side + high)] = 0
        fit = lambda n, most: np.minimum(n, most).astype(np.uint8)
        out = Contexts(self.h, self.h2, np.full(len(self), kind, np.uint8), around, fit(self.before, side - low), fit(self.after, high))
        return out, _mixed(around[:, high : side + low], 6001, self.h)


def _contexts(doc: np.ndarray, at: np.ndarray, h: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int, q: int) -> Contexts:
    """The bytes before and after each anchor (zeros beyond the text) and how many are real."""
    side = length - q
    padded = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(side + q, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, length + side)[at]
    before = np.minimum(at - offsets[doc], side)
    after = np.minimum(offsets[doc + 1] - at - q, side)
    around = np.concatenate([view[:, :side], view[:, side + q :]], 1)
    column = np.arange(2 * side)
    around[(column < (side - before)[:, None]) | (column >= (side + after)[:, None])] = 0
    return Contexts(h, (_mixed(view[:, side : side + q], 5001) >> np.uint64(32)).astype(np.uint32), np.zeros(len(h), np.uint8), around, before.astype(np.uint8), after.astype(np.uint8))


def _occurrences(batches: Iterator[pa.RecordBatch], length: int, q: int, bits: int, table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Contexts, np.ndarray]]:
    """(doc_id, text hash, place, contexts, hash that deals them out) of the shared anchors of each slice; common anchors once for each range of windows."""
    shared, common = (np.frombuffer(x, np.uint8) for x in table.value)
    for batch in batches:
        ids = batch.column("doc_id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = batch.column("th").to_numpy()
        for i, _, data, offsets in K.slices(batch.column("text"), K.SLICE // 2):
            doc, at, h = _anchors(data, offsets, K.Text(data, K.BYTE), length, q)
            slot = ((h & _LOW) >> np.uint64(48 - bits)).astype(np.int64)
            marked = lambda t, s: ((t[s >> 3] >> (s & 7).astype(np.uint8)) & 1).astype(bool)
            hit = marked(shared, slot) & known[i + doc]
            doc, at, h, slot = doc[hit], at[hit], h[hit], slot[hit]
            if not len(doc):
                continue
            c = _contexts(doc, at, h, data, offsets, length, q)
            split = marked(common, slot >> FEWER)
            for kind, (low, high) in enumerate(_ranges(length - q)):
                of = np.flatnonzero(split if kind else ~split)
                if len(of):
                    part, dealt = c.take(of).only(kind, low, high) if kind else (c.take(of), h[of])
                    yield ids[i + doc[of]], texts[i + doc[of]], at[of] - offsets[doc[of]], part, dealt


def _places(*how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, at, c, _ in _occurrences(batches, *how):
            n1, n2 = c.names()
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts), pa.array(at.astype(np.int32)), pa.array(n1.view(np.int64)), pa.array(n2.view(np.int64))], names=["doc_id", "th", "at", "n1", "n2"])

    return run


def _least(names: tuple[np.ndarray, np.ndarray], doc: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of each name's smallest doc_id, and whether other documents have the name too."""
    order = np.lexsort((doc, *names))
    a, b = names[0][order], names[1][order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    end = np.r_[start[1:], len(order)] - 1
    other = (doc[order[end]] != doc[order[start]]) | np.logical_or.reduceat(several[order], start)
    return order[start], other


def _distinct(length: int, q: int, bits: int, table, buckets: int):
    """Each task's distinct contexts: rows of (bucket, packed arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        packer = pa.Codec("zstd", compression_level=5)

        def merged(parts: list[tuple]) -> tuple:
            c, names = Contexts.joined([p[0] for p in parts]), tuple(np.concatenate([p[1][k] for p in parts]) for k in (0, 1))
            bucket, doc, several = (np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))
            at, several = _least(names, doc, several)
            return c.take(at), tuple(x[at] for x in names), bucket[at], doc[at], several

        def flush() -> pa.RecordBatch:
            c, _, bucket, doc, several = merged(held)
            held.clear()
            order = np.lexsort((c.kind, c.h, bucket))  # neighbours look alike, which packs them well
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for i in range(buckets):
                at = order[cuts[i] : cuts[i + 1]]
                if len(at):
                    parts = (np.uint64(len(at)), c.h[at], doc[at], c.h2[at], several[at].astype(np.uint8), c.kind[at], c.before[at], c.after[at], c.around[at])
                    whole = b"".join(x.tobytes() for x in parts)
                    rows.append((i, len(whole), packer.compress(whole, asbytes=True)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "size", "contexts"])

        total = 0
        for ids, _, _, c, dealt in _occurrences(batches, length, q, bits, table):
            held.append(merged([(c, c.names(), (dealt % np.uint64(buckets)).astype(np.int32), ids, np.zeros(len(c), bool))]))
            total += len(held[-1][0])
            if total > 600_000:
                held[:] = [merged(held)]
                total = len(held[0][0])
                if total > 300_000:
                    yield flush()
                    total = 0
        if total:
            yield flush()

    return run


def _classes(length: int, q: int):
    """For each distinct context of a bucket, runs of windows with the same smallest doc_id: (n1, n2, low, high, least)."""
    side = length - q
    none = np.iinfo(np.int64).max

    def run(table: pa.Table) -> pa.Table:
        parts, docs, flags = [], [], []
        for x, size in zip(table.column("contexts"), table.column("size").to_pylist(), strict=True):
            b = np.frombuffer(pa.decompress(x.as_buffer(), size, codec="zstd"), np.uint8)
            n = int(b[:8].view(np.uint64)[0])
            cuts = np.cumsum([8, 8 * n, 8 * n, 4 * n, n, n, n, n, 2 * side * n])
            f = [b[cuts[k] : cuts[k + 1]] for k in range(8)]
            parts.append(Contexts(f[0].view(np.uint64), f[2].view(np.uint32), f[4], f[7].reshape(n, -1), f[5], f[6]))
            docs.append(f[1].view(np.int64))
            flags.append(f[3].astype(bool))
        c, doc, several = Contexts.joined(parts), np.concatenate(docs), np.concatenate(flags)
        parts.clear()
        names = c.names()
        at, several = _least(names, doc, several)
        at, several = (x[np.lexsort((c.h2[at], c.h[at], c.kind[at]))] for x in (at, several))
        c, doc, names = c.take(at), doc[at], tuple(x[at] for x in names)
        # Rows of one anchor and kind are neighbours now; as many whole anchors as fit are refined together.
        new = np.r_[True, (c.h[1:] != c.h[:-1]) | (c.h2[1:] != c.h2[:-1]) | (c.kind[1:] != c.kind[:-1])]
        first, ranges, out, i = np.flatnonzero(new), _ranges(side), [], 0
        kind = c.kind[first]
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(first, first[i] + TOGETHER, "right")) - 1)
            j = min(j, int(np.searchsorted(kind, kind[i], "right")))
            lo, hi = first[i], first[j] if j < len(first) else len(c)
            out.append(windows(c.take(slice(lo, hi)), np.cumsum(new[lo:hi]) - 1, doc[lo:hi], several[lo:hi], ranges[c.kind[lo]], lo))
            i = j
        row, low, high, value = (np.concatenate(x) for x in zip(*out, strict=True))
        n1, n2 = (x[row].view(np.int64) for x in names)
        return pa.table({"n1": n1, "n2": n2, "low": low.astype(np.int16), "high": high.astype(np.int16), "least": value})

    def windows(c: Contexts, anchor: np.ndarray, doc: np.ndarray, several: np.ndarray, span: tuple[int, int], start: int) -> tuple[np.ndarray, ...]:
        lo, hi = span
        least = np.repeat(doc[:, None], hi - lo + 1, 1)
        company = np.flatnonzero(np.bincount(anchor)[anchor] > 1)
        if len(company):
            own = doc[company]
            for r, bucket in window_buckets(anchor[company], c.around[company], lo, hi):
                smallest = np.full(len(company), none)
                np.minimum.at(smallest, bucket, own)
                least[company, r - lo] = smallest[bucket]
        r = np.arange(lo, hi + 1)
        real = (r[None, :] <= c.after[:, None]) & (side - r[None, :] <= c.before[:, None])
        least = np.where(real, least, none)
        change = np.ones((len(least), hi - lo + 2), bool)
        change[:, 1:-1] = least[:, 1:] != least[:, :-1]
        row, low = np.nonzero(change[:, :-1])
        _, high = np.nonzero(change[:, 1:])
        value = least[row, low]
        # What one document alone has and no smaller one holds is of use to nobody.
        keep = (value != none) & ((value < doc[row]) | several[row])
        return row[keep] + start, low[keep] + lo, high[keep] + lo, value[keep]

    return run


def repeated_spans(documents: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, th, start, end): the maximal runs of bytes covered by windows that a document with a smaller id holds.

    ``th`` is the text's xxhash64 where some doc_id has several texts, which
    it tells apart, and else 0, which costs nothing to send.
    """
    spark = documents.sparkSession
    q = min(GRAM, length // 2 + 1)
    rows = documents.select("doc_id", "text").where(F.octet_length("text") >= length)
    ids = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    volume, several = ids.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count_if(F.col("a") != F.col("b"))).first()
    rows = rows.withColumn("th", F.xxhash64("text") if several else F.lit(0).cast("long"))
    buckets = min(max(8, 4 * partitions(spark), volume // BUCKET), 1 << 17)
    hashed = mapped(rows.select("text"), _hashed(length, q, buckets, BITS), "bucket int, once binary, twice binary, many binary")
    parts = grouped(hashed, "bucket", _shared(buckets, BITS), "bucket int, part binary, common binary")
    span = _span(buckets, BITS) // 8
    tables = bytearray(span * buckets), bytearray((span >> FEWER) * buckets)
    for row in parts.collect():  # the bit tables, whose size is fixed
        for table, part, size in zip(tables, (row["part"], row["common"]), (span, span >> FEWER), strict=True):
            table[row["bucket"] * size : (row["bucket"] + 1) * size] = part
    how = (length, q, BITS, spark.sparkContext.broadcast(tuple(map(bytes, tables))))
    distinct = mapped(rows, _distinct(*how, buckets), "bucket int, size long, contexts binary")
    classes = grouped(distinct, "bucket", _classes(length, q), "n1 long, n2 long, low short, high short, least long")
    side = length - q
    occurrences = mapped(rows, _places(*how), "doc_id long, th long, at int, n1 long, n2 long")
    matched = occurrences.join(classes, ["n1", "n2"]).where("least < doc_id")
    # A window with r bytes after its anchor starts at the anchor's place less side - r.
    runs = matched.select("doc_id", "th", (F.col("at") - side + F.col("low")).alias("start"), (F.col("at") + q + F.col("high")).alias("end"))
    key = Window.partitionBy("doc_id", "th").orderBy("start", "end")
    reach = F.max("end").over(key.rowsBetween(Window.unboundedPreceding, -1))
    islands = runs.withColumn("new", F.when(reach >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(key.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "th", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def _whole_characters(b: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the bytes of characters that they cover in part only."""
    out = []
    for lo, hi in runs:
        while lo < hi and b[lo] & 0xC0 == 0x80:
            lo += 1
        while hi > lo and hi < len(b) and b[hi] & 0xC0 == 0x80:
            hi -= 1
        if hi > lo:
            out.append((lo, hi))
    return out


def _without(b: bytes, runs: list[tuple[int, int]]) -> bytes:
    at = [0, *(x for run in runs for x in run), len(b)]
    return b"".join(b[at[k] : at[k + 1]] for k in range(0, len(at), 2))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.raw(batch.column("text"))
        made = []
        for i, s in enumerate(batch.column("spans")):
            b = data[offsets[i] : offsets[i + 1]].tobytes()
            runs = sorted((x["start"], x["end"]) for x in s.as_py() or ())
            rest = _without(b, runs)
            made.append((len(b), len(b) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), _without(b, _whole_characters(b, runs)).decode()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *columns, batch.column("spans")], names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"])


def _with_spans(documents: DataFrame, length: int, row: Column) -> DataFrame:
    """row, n_bytes, n_removed, n_spans, kept_sha256, kept_text and spans of each row of ``documents``."""
    spans = repeated_spans(documents, length).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = checkpointed(spans.select(F.struct("doc_id", "th").alias("of"), "spans"))
    total, told = spans.agg(F.coalesce(F.sum(F.size("spans")), F.lit(0)), F.coalesce(F.bool_or(F.col("of.th") != 0), F.lit(False))).first()
    rows = documents.select(row.alias("row"), "text", F.struct("doc_id", (F.xxhash64("text") if told else F.lit(0).cast("long")).alias("th")).alias("own"))
    rows = rows.join(sized(spans, total, 2_000_000), F.col("own") == F.col("of"), "left").select("row", "text", "spans")
    made = StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, spans array<struct<start:int,end:int>>")
    return mapped(rows, _cut, StructType([rows.schema["row"], *made]))


def removed(documents: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text and spans of each row.

    Every byte goes that is covered by a string of ``length`` bytes that also
    starts in a document with a smaller doc_id, judged on the input. Null is
    the empty text. A row with a null doc_id neither loses bytes nor makes
    others lose them. Rows with one doc_id do not count as smaller than each
    other. ``kept_text`` keeps a character that is covered in part only; the
    other columns are about bytes. Anchors are told apart by 96 bits, the
    bytes beside them by themselves, and a context has a name of 128 bits.
    """
    out = _with_spans(documents, length, F.struct("doc_id"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans")


def without_repeats(documents: DataFrame, length: int = 100) -> DataFrame:
    """The documents with their repeated passages cut out of ``text`` and ``n_chars`` set to what is left; null stays null."""
    out = _with_spans(documents, length, F.struct(F.struct("*").alias("given"), F.col("text").isNull().alias("empty")))
    text = F.when(F.col("row.empty"), F.lit(None)).otherwise(F.col("kept_text"))
    new = {"text": text, "n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast("long")}
    return out.select(*(new.get(c, F.col("row.given").getField(c)).alias(c) for c in documents.columns))
