"""Line deduplication over range-partitioned line hashes.

Every line that is long enough gives a row (128-bit hash of its key,
document, line number). Rows are dealt by ranges of (hash, document), so a
line that stands in a third of all documents fills several partitions rather
than one, and sorted within them by hash, falling document and line. A
partition is read as a stream: the first document of a key is the one that
keeps it, and once a key has been seen in enough documents its later rows are
lines to drop. Only a partition's first and last key can go on in a
neighbour: they leave a summary (two rows a partition at most), and what they
may drop waits for the sum of those.

The result is one keep bitmap a document (a bit a line, packed and
compressed), not text; ``deduplicated`` joins it to the texts.

A key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends and
with A-Z in lower case. Rows of one doc_id with different texts are different
documents; repeated rows are one. The row with a null doc_id counts as the
smallest; of equal largest doc_ids all keep the line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, StructType

from . import kernels as K
from .common import checkpointed, mapped

_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True
#: A second random value for each byte, A-Z as a-z: both hashes together name a key.
_SECOND = np.random.default_rng(20250911).integers(0, 1 << 63, 256, dtype=np.uint64) * K.U(2) + K.U(1)
_SECOND[65:91] = _SECOND[97:123]

CERTAIN, WAITING, SUMMARY = 0, 1, 2


def keys(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, two hashes) of the lines whose key has ``least`` or more code points (at least one)."""
    starts, ends, doc = K.words(data, offsets, _NEWLINE)
    text = ~K.SPACE[data]
    places, before = np.flatnonzero(text), np.r_[0, np.cumsum(text)]
    some = before[ends] > before[starts]
    starts, ends, doc = starts[some], ends[some], doc[some]
    newlines = np.r_[0, np.cumsum(data == 0x0A)]
    line = newlines[starts] - newlines[offsets[doc]]
    starts, ends = places[before[starts]], places[before[ends] - 1] + 1
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    long = points[ends] - points[starts] >= least
    starts, ends = starts[long], ends[long]
    return doc[long], line[long], K.Text(data).ranges(starts, ends).view(np.int64), K.Text(data, _SECOND).ranges(starts, ends).view(np.int64)


def _hashed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.slices(batch.column("text")):
                if not len(data):
                    continue
                doc, line, h1, h2 = keys(data, offsets, least)
                given = [batch.column(c).slice(i, j - i).take(pa.array(doc)) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), *given, pa.array(line.astype(np.int32))], names=["h1", "h2", "doc_id", "text_hash", "line"])

    return run


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before (nulls are equal)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differ | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def _streamed(least_docs: int):
    """Rows in order of (hash, falling document, line) to lines that go, lines that may go, and summaries of the keys at the partition's ends."""

    def tagged(part: pa.RecordBatch, kind: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(kind >= 0)
        part = part.take(pa.array(at))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(kind[at].astype(np.int8)), pa.nulls(len(at), pa.int64())], names=[*part.schema.names, "kind", "docs"])

    def summary(row: pa.RecordBatch, docs: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*row.columns, pa.array([SUMMARY], pa.int8()), pa.array([docs], pa.int64())], names=[*row.schema.names, "kind", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = False
        lead = None  # of a key that goes on: its first row, its documents, its last row, whether it opened the partition
        docs, last, opening = 0, None, False
        held = None  # rows of a key that has too few documents as yet
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch, held = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0], None
            if last is not None:  # compared with the row before
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            h1, h2, th = (batch.column(c).to_numpy() for c in ("h1", "h2", "text_hash"))
            key_new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            id_new = np.r_[True, _changes(batch.column("doc_id"))] | key_new
            doc_new = id_new | np.r_[True, th[1:] != th[:-1]]
            goes_on = False
            if last is not None:
                batch, goes_on = batch.slice(1), not key_new[1]
                key_new, id_new, doc_new = key_new[1:], id_new[1:], doc_new[1:]
                if not goes_on and opening:
                    yield summary(lead, docs)
            starts = np.flatnonzero(np.r_[True, key_new[1:]])
            run_of = np.cumsum(np.r_[True, key_new[1:]]) - 1
            count = np.add.reduceat(doc_new.astype(np.int64), starts)
            stays = np.cumsum(id_new)
            stays = stays == stays[starts][run_of]
            ends = np.r_[starts[1:], batch.num_rows]
            if goes_on:
                count[0] += docs
                own = pc.equal(batch.column("doc_id").slice(0, ends[0]), lead.column("doc_id")[0]) if lead.column("doc_id")[0].is_valid else pc.is_null(batch.column("doc_id").slice(0, ends[0]))
                stays[: ends[0]] = pc.fill_null(own, False).to_numpy(zero_copy_only=False)
            first = opening if goes_on else not opened
            kind = np.where((count >= least_docs)[run_of] & ~stays, CERTAIN, -1)
            if first:
                kind[: ends[0]] = WAITING
            z = len(starts) - 1
            tail = starts[z]
            if first and z > 0:
                yield summary(lead if goes_on else batch.slice(0, 1), int(count[0]))
            lead = lead if goes_on and z == 0 else batch.slice(tail, 1)
            opening = first and z == 0
            if not opening and count[z] < least_docs:
                kind[tail:] = -1
                held, last = batch.slice(tail), None
            else:
                docs, last = int(count[z]), batch.slice(batch.num_rows - 1)
            opened = True
            yield tagged(batch, kind)
        if held is not None:
            yield tagged(held, np.full(held.num_rows, WAITING))
            pairs = pa.table({"d": held.column("doc_id"), "t": held.column("text_hash")})
            yield summary(held.slice(0, 1), pairs.group_by(["d", "t"]).aggregate([]).num_rows)
        elif last is not None:
            yield summary(lead, docs)

    return run


def dropped(documents: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, line): the lines that go, numbered from 0 within their document."""
    given = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = given.schema["doc_id"]
    hashed = StructType.fromDDL("h1 long, h2 long").add("doc_id", kind.dataType).add("text_hash", LongType()).add("line", IntegerType())
    rows = mapped(given.where(F.length("text") >= least_chars), _hashed(least_chars), hashed)
    falling = F.col("doc_id").desc_nulls_last()
    dealt = rows.repartitionByRange("h1", "h2", falling, "text_hash").sortWithinPartitions("h1", "h2", falling, "text_hash", "line")
    found = checkpointed(mapped(dealt, _streamed(least_docs), StructType([*hashed.fields]).add("kind", ByteType()).add("docs", LongType())))
    sums = found.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("doc_id").alias("lead")).where(F.col("n") >= least_docs).drop("n")
    waiting = found.where(F.col("kind") == WAITING).join(F.broadcast(sums), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("lead")))  # two rows a partition at most
    return found.where(F.col("kind") == CERTAIN).select("doc_id", "text_hash", "line").union(waiting.select("doc_id", "text_hash", "line"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, lists = batch.column("n_lines").to_numpy(), batch.column("gone")
        flat, at = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        bitmaps = []
        for n, a, b in zip(n_lines, at, at[1:], strict=False):
            bits = np.ones(n, bool)
            bits[flat[a:b]] = False
            bitmaps.append(zlib.compress(np.packbits(bits).tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), batch.column("n_lines"), pa.array(np.diff(at)), pa.array(bitmaps, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(documents: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep) of each distinct (doc_id, text).

    ``keep`` has a bit for each line, the first one highest in the first byte,
    packed and compressed with zlib; ``text_hash`` is the text's xxhash64. A
    null or empty text has one empty line.
    """
    text = F.coalesce("text", F.lit(""))
    lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    every = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), lines.alias("n_lines"), F.lit(None).cast("int").alias("line"))
    gone = dropped(documents, least_chars, least_docs).select("doc_id", "text_hash", F.lit(None).cast("long").alias("n_lines"), "line")
    by_doc = every.union(gone).groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("line").alias("gone"))
    return mapped(by_doc, _packed, StructType([every.schema["doc_id"], *StructType.fromDDL("text_hash long, n_lines long, n_dropped long, keep binary")]))


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, n, gone, keep in zip(batch.column("text"), batch.column("n_lines").to_pylist(), batch.column("n_dropped").to_pylist(), batch.column("keep"), strict=True):
            text = text.as_py() or ""
            if gone:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), count=n).tolist()
                text = "\n".join([line for line, stays in zip(text.split("\n"), bits, strict=True) if stays])
            out.append(text)
        made = [batch.column(c) for c in ("row", "n_lines", "n_dropped")]
        yield pa.RecordBatch.from_arrays([*made, pa.array(out, pa.string())], names=["row", "n_lines", "n_dropped", "text"])


def deduplicated(documents: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """All columns of ``documents``, ``text`` without the lines that go (null: empty), and ``line_dedup`` (n_lines, n_dropped).

    A column of that name is kept; the made one then gets underscores.
    """
    maps = keep_bitmaps(documents, least_chars, least_docs).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t"), "n_lines", "n_dropped", "keep")
    kept = [c for c in documents.columns if c != "text"]
    given = documents.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), "text", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"))
    joined = given.join(maps, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_t"))).select("row", "text", "n_lines", "n_dropped", "keep")
    out = mapped(joined, _applied, StructType([given.schema["row"], *StructType.fromDDL("n_lines long, n_dropped long, text string")]))
    made = "line_dedup"
    while made.lower() in (c.lower() for c in documents.columns):
        made += "_"
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns]
    return out.select(*columns, F.struct("n_lines", "n_dropped").alias(made))
