"""Alignment of two tokenizers' tokens by the bytes they end at.

A text gets one label for each of its bytes: no token ends there, one of A
does, one of B does, or both do. A regular expression scans the labels for
spans up to each "both"; the labels counted in a span say how many tokens of
either side form a group, and every A token of a group is linked with every B
token of it.

One pass encodes, labels and groups each text and writes ids and group sizes
to a table in the shared folder; with them each task adds up in how many of
its documents an id pair is linked and writes its sums beside them (what is
shuffled are sums, of which a task has one a pair). A second pass looks the
corpus-wide counts up. Those of the commonest pairs are broadcast, as many as
``BROADCAST_ROWS`` allows; the others, each of them in few documents, meet
their counts in a shuffle.

A is a byte-level BPE vocabulary (a ``tokenizers`` file), B a SentencePiece
model. The files are read on the driver and broadcast.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import operator
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import kernels as K
from .common import BROADCAST_ROWS, checkpointed, mapped, shared_folder

MARK = "▁"
#: Labels of a byte.
NONE, A_END, B_END, BOTH = 0, 1, 2, 3
_SPAN = re.compile(rb"[^\x03]*\x03")
#: Fixed value: how a byte-level BPE of this kind cuts a text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PARTS = [operator.itemgetter(i) for i in range(3)]
#: A space between two characters that are no white space.
_CUT = re.compile(r" (?<=\S )(?=\S)")
_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
#: Sums of pairs that a task holds before it merges them, and before it writes them.
MERGE, HELD = 400_000, 1_600_000
#: Pairs that are expanded at once.
EXPANDED = 1 << 18
#: Words that a worker remembers, and the longest of them.
MEMORY, LONGEST = 60_000, 40
#: New words that are encoded at once.
TOGETHER = 5000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabularies:
    """Both vocabulary files; a worker makes its encoders from them when first needed."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = a, b

    @classmethod
    def load(cls, a: str, b: str) -> Vocabularies:
        return cls(Path(a).read_bytes(), Path(b).read_bytes())

    def sizes(self) -> tuple[int, int]:
        """One more than the largest id of each side."""
        import sentencepiece

        return max(json.loads(self.a)["model"]["vocab"].values()) + 1, sentencepiece.SentencePieceProcessor(model_proto=self.b).get_piece_size()


class Encoders:
    """Ids, token bytes and groups of both sides.

    No token of either side crosses a space between two characters that are
    no white space: A cuts there before it merges, and no piece of B has a
    marker behind another character. So what lies between such spaces is
    encoded, labelled and grouped once and remembered (a bounded memory).
    """

    def __init__(self, files: Vocabularies):
        import sentencepiece

        self.file, model = files.a, json.loads(files.a)
        byte, self.pieces_b = byte_characters(), sentencepiece.SentencePieceProcessor(model_proto=files.b)
        vocabulary, b = model["model"]["vocab"], self.pieces_b
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token)
        self.bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(MARK, " ").encode() for i in range(b.get_piece_size())]
        self.crossing = any(MARK in b.id_to_piece(i).lstrip(MARK) for i in range(b.get_piece_size()))
        self.fast, self._slow = self._byte_level(model), None
        self.memory: dict[str, tuple[bytes, bytes, bytes] | None] = {}

    def _byte_level(self, file: dict):
        """A faster encoder with the file's results, if its merges stand in the order of their ids and its cuts are the usual ones."""
        import tiktoken

        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in merges]
        ordered = None not in merged and all(x < y for x, y in zip(merged, merged[1:], strict=False)) and len({x for x in self.bytes_a if len(x) == 1}) == 256
        plain = file["normalizer"] is None and file["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.bytes_a) if t}, special_tokens={}) if ordered and plain else None

    @property
    def slow(self):
        """The file's own encoder."""
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self.file.decode())
            self._slow.encode_special_tokens = True
        return self._slow

    def encode_a(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode(text, disallowed_special=())
            except ValueError:  # the pattern gives up on very long runs of white space
                return self._blank(text)
        return self.slow.encode(text, add_special_tokens=False).ids

    def _blank(self, text: str) -> list[int]:
        """The ids of a text with very long runs of white space: the pattern makes a run one stretch, but for its last character if another follows."""
        whole, out, last = type(self.fast)("whole", pat_str=r"[\s\S]+", mergeable_ranks=self.fast._mergeable_ranks, special_tokens={}), [], 0
        for run in _BLANK.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.fast.encode_ordinary(text[last : run.start()]) + whole.encode_ordinary(text[run.start() : end])
            last = end
        return out + self.fast.encode_ordinary(text[last:])

    def _made(self, words: list[str], ids_a: list[int], ids_b: list[int]) -> list[tuple[bytes, bytes, bytes]] | None:
        """The packed ids and group sizes of each word, from those of the words joined by spaces; None if their bytes are not the words'."""
        want = [(" " + w).encode() for w in words]
        token_a, token_b, joined = [self.bytes_a[i] for i in ids_a], [self.bytes_b[i] for i in ids_b], b"".join(want)
        if b"".join(token_a) != joined or b"".join(token_b) != joined:
            return None
        ends_a, ends_b = (np.cumsum(np.fromiter(map(len, t), np.int64, len(t))) for t in (token_a, token_b))
        last = np.cumsum(np.fromiter(map(len, want), np.int64, len(want)))
        sizes = np.stack(groups(labels(ends_a, ends_b, len(joined))), 1)  # a word's end is a label "both"
        ends_g = ends_a[np.cumsum(sizes[:, 0]) - 1]
        columns = []
        for row, ends, each in ((ids_a, ends_a, 1), (ids_b, ends_b, 1), (sizes, ends_g, 2)):
            packed = np.array(row, np.int32).tobytes()
            cuts = [0, *(4 * each * np.searchsorted(ends, last, "right")).tolist()]
            columns.append([packed[x:y] for x, y in zip(cuts, cuts[1:], strict=False)])
        return list(zip(*columns, strict=True))

    def _new(self, words: list[str]) -> dict[str, tuple[bytes, bytes, bytes] | None]:
        """Words that spaces cut off are encoded together, the others and those that a tokenizer does not give back one by one."""
        out, alone, together = {}, [], []
        for w in words:
            (alone if self.crossing or self.fast is None or w[0].isspace() or w[-1].isspace() else together).append(w)
        for i in range(0, len(together), TOGETHER):
            part = together[i : i + TOGETHER]
            text = " ".join(part)
            made = self._made(part, self.encode_a(" " + text), self.pieces_b.encode(text))
            if made is None:
                alone += part
            else:
                out.update(zip(part, made, strict=True))
        for w in alone:
            made = self._made([w], self.encode_a(" " + w), self.pieces_b.encode(w))
            out[w] = made[0] if made else None
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes, bytes]]:
        """Packed ids of both sides and group sizes (A, B, A, B, ...); none where a text is empty or where one side's bytes are not the text's."""
        memory, whole = self.memory, self.crossing or self.fast is None
        cut = [None if not text or MARK in text else [text] if whole else _CUT.split(text) for text in texts]  # B reads a marker as a space
        new = dict.fromkeys(itertools.filterfalse(memory.__contains__, itertools.chain.from_iterable(words for words in cut if words)))
        memory.update(self._new(list(new)))
        out = []
        for words in cut:
            found = list(map(memory.__getitem__, words)) if words else [None]
            out.append((b"", b"", b"") if None in found else tuple(b"".join(map(part, found)) for part in _PARTS))
        room = MEMORY - (len(memory) - len(new))
        for word in new:  # the first ones, among them the frequent ones, stay
            if room > 0 and len(word) <= LONGEST:
                room -= 1
            else:
                del memory[word]
        return out


_made: tuple[bytes, Encoders] | None = None


def encoders(files: Vocabularies) -> Encoders:
    """This worker's encoders of these files."""
    global _made
    name = hashlib.sha256(files.a + b"\0" + files.b).digest()
    if _made is None or _made[0] != name:
        _made = (name, Encoders(files))
    return _made[1]


def labels(ends_a: np.ndarray, ends_b: np.ndarray, n: int) -> bytes:
    """One label for each of n bytes, from the places behind the tokens' last bytes."""
    out = np.zeros(n, np.uint8)
    out[ends_a - 1] |= A_END
    out[ends_b - 1] |= B_END
    return out.tobytes()


def groups(label: bytes) -> tuple[np.ndarray, np.ndarray]:
    """How many A and B tokens each group has."""
    spans = _SPAN.findall(label)
    both = len(spans)
    n_a, n_b = (np.fromiter(map(bytes.count, spans, itertools.repeat(c)), np.int64, both) + 1 for c in (A_END, B_END))
    return n_a, n_b


def starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def pairs(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray, sizes: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, id pair, links) for parts of the links of all groups, each part summed up; only a part is in memory."""
    n_links, first_a, first_b = n_a * n_b, starts(n_a), starts(n_b)
    ends = np.cumsum(n_links)
    total = int(ends[-1]) if len(ends) else 0
    for low in range(0, total, EXPANDED):
        at = np.arange(low, min(low + EXPANDED, total))
        g = np.searchsorted(ends, at, "right")
        i, j = np.divmod(at - (ends[g] - n_links[g]), n_b[g])
        pair = a[first_a[g] + i] * sizes[1] + b[first_b[g] + j]
        key, links = np.unique(doc[g] * (sizes[0] * sizes[1]) + pair, return_counts=True)
        yield *np.divmod(key, sizes[0] * sizes[1]), links


def summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The parts as one, rows with equal keys added up; the last column has the numbers."""
    if len(parts) == 1:
        return parts[0]
    *keys, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort(keys[::-1])
    keys, n = [k[order] for k in keys], n[order]
    if not len(n):
        return *keys, n
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
    return *(k[new] for k in keys), np.add.reduceat(n, np.flatnonzero(new))


def _names(vocabulary: int, inner: bytes, last: bytes) -> pa.Array:
    """Each id in decimal with the separator behind it: ``inner``, then from id + vocabulary on ``last``."""
    return pa.array([str(i).encode() + s for s in (inner, last) for i in range(vocabulary)], pa.binary())


def digests(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, groups_of: np.ndarray, names: tuple[pa.Array, pa.Array]) -> list[str]:
    """sha256 of each text's groups as ``a1,a2|b1;a3|b2,b3``; the empty string for a text without groups."""
    tokens = n_a + n_b
    place = starts(tokens)
    at_a = np.repeat(place - starts(n_a), n_a) + np.arange(len(a))
    at_b = np.repeat(place + n_a - starts(n_b), n_b) + np.arange(len(b))
    va, vb = len(names[0]) // 2, len(names[1]) // 2
    order = np.empty(len(a) + len(b), np.int64)
    order[at_a], order[at_b] = a, b + 2 * va
    order[place + n_a - 1] += va
    order[place + tokens - 1] += vb
    written = pa.concat_arrays(names).take(pa.array(order))
    _, offsets, data = written.buffers()
    ends = np.frombuffer(offsets, np.int32)[: len(order) + 1]
    cuts = ends[np.r_[0, np.cumsum(tokens)][np.r_[0, np.cumsum(groups_of)]]].tolist()
    view = memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(view[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cuts, cuts[1:], strict=False)]


def _narrow(vocabulary: int):
    return np.uint16 if vocabulary <= 1 << 16 else np.int32


_MADE = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_KEPT = "a binary, b binary, g binary, pair long, docs long"


def _aligned(files, vocabulary: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoders(files.value)
        names = _names(vocabulary[0], b",", b"|"), _names(vocabulary[1], b",", b";")
        sums, held, kind = [], 0, pa.null()
        columns = ["row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "g", "pair", "docs"]
        narrow = [_narrow(v) for v in vocabulary]

        def written() -> pa.RecordBatch:
            pair, docs = summed(sums)
            n = len(pair)
            sums.clear()
            nothing = [pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, pa.string())] + [pa.nulls(n, pa.binary())] * 3
            return pa.RecordBatch.from_arrays([pa.nulls(n, kind), *nothing, pa.array(pair), pa.array(docs)], names=columns)

        for batch in batches:
            kind = batch.schema.field("row").type
            for i, j, _, _ in K.slices(batch.column("text"), rows=2000):
                n = j - i
                packed_a, packed_b, sizes = zip(*made.encode(batch.column("text").slice(i, n).to_pylist()), strict=True)
                len_a, len_b = (np.array([len(x) // 4 for x in packed], np.int64) for packed in (packed_a, packed_b))
                a, b = (np.frombuffer(b"".join(packed), np.int32).astype(np.int64) for packed in (packed_a, packed_b))
                n_a, n_b = np.frombuffer(b"".join(sizes), np.int32).astype(np.int64).reshape(-1, 2).T
                groups_of = np.array([len(x) // 8 for x in sizes], np.int64)
                doc = np.repeat(np.arange(n), groups_of)
                links = np.zeros(n, np.int64)
                np.add.at(links, doc, n_a * n_b)
                parts = list(pairs(a, b, n_a, n_b, doc, vocabulary))
                if parts:
                    _, pair, _ = summed(parts)
                    pair, docs = np.unique(pair, return_counts=True)
                    sums.append((pair, docs.astype(np.int64)))
                    held += len(pair)
                    if held > MERGE:
                        sums[:] = [summed(sums)]
                        held = len(sums[0][0])
                        if held > HELD // 2:
                            yield written()
                            held = 0
                out = [batch.column("row").slice(i, n), *(pa.array(x) for x in (len_a, len_b, groups_of, links)), pa.array(digests(a, b, n_a, n_b, groups_of, names))]
                kept = [pa.array([np.frombuffer(x, np.int32).astype(t).tobytes() for x in packed], pa.binary()) for packed, t in zip((packed_a, packed_b), narrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*out, *kept, pa.array(sizes, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=columns)
        if sums:
            yield written()

    return run


def _looked_up(sent, vocabulary: tuple[int, int]):
    """Links to a commonest pair of their A id, sums of counts, and what pairs were not among the broadcast ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, docs, best = sent.value
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                n = batch.num_rows
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), _narrow(v)).astype(np.int64) for c, v in zip("ab", vocabulary, strict=True))
                sizes = batch.column("g").to_pylist()
                n_a, n_b = np.frombuffer(b"".join(sizes), np.int32).astype(np.int64).reshape(-1, 2).T
                doc = np.repeat(np.arange(n), [len(x) // 8 for x in sizes])
                doc, pair, links = summed(list(pairs(a, b, n_a, n_b, doc, vocabulary)) or [(np.zeros(0, np.int64),) * 3])
                at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
                hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                d, at, w = doc[hit], at[hit], links[hit]
                n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(n_best, d, np.where(best[at], w, 0))
                np.add.at(total, d, w * docs[at])
                rare = pa.StructArray.from_arrays([pa.array(pair[~hit]), pa.array(links[~hit])], names=["pair", "links"])
                others = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(doc[~hit], minlength=n))].astype(np.int32)), rare)
                yield pa.RecordBatch.from_arrays([batch.column("made"), pa.array(n_best), pa.array(total), others], names=["made", "n_best", "count_sum", "others"])

    return run


def aligned(documents: DataFrame, files: Vocabularies) -> tuple[DataFrame, DataFrame]:
    """The alignment table and the pair table, both in the shared folder.

    The first has for each row of ``documents`` all its columns but the text
    (as ``row``), n_a, n_b, n_groups, n_links, groups_sha256, the ids ``a``
    and ``b`` (packed, of two bytes each, four for more than 65,536 ids), and
    ``g``, the numbers of A and B tokens of each group in turn (of four bytes
    each). A text
    that is null or empty, or that one of the tokenizers does not give back
    byte for byte, has no tokens. The second has for each linked id pair a, b
    the number of documents that link it and whether no other pair of its A
    id is in more.
    """
    spark = documents.sparkSession
    vocabulary = files.sizes()
    sent = spark.sparkContext.broadcast(files)
    folder = f"{shared_folder(spark)}/alignment-{uuid.uuid4().hex}"
    kept = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    given = documents.select(F.struct(*kept).alias("row"), "text")
    mapped(given, _aligned(sent, vocabulary), StructType([StructField("row", given.schema["row"].dataType), *StructType.fromDDL(f"{_MADE}, {_KEPT}")])).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    table = spark.read.parquet(folder)
    sums = table.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("docs").alias("docs"))
    of_a = F.floor(F.col("pair") / F.lit(vocabulary[1])).cast("int")
    sums = checkpointed(sums.withColumn("a", of_a))
    most = sums.groupBy("a").agg(F.max("docs").alias("most"))  # at most one row an id of A
    counted = sums.join(F.broadcast(most), "a").select("a", (F.col("pair") % vocabulary[1]).cast("int").alias("b"), "pair", "docs", (F.col("docs") == F.col("most")).alias("best"))
    return table.where(F.col("pair").isNull()).drop("pair", "docs"), counted


def scored(documents: DataFrame, files: Vocabularies, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The columns of ``documents`` but the text, and n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    Repeated rows count as a document each. A column with the name of a made
    one stays, the made one then gets underscores.
    """
    vocabulary = files.sizes()
    texts, counted = aligned(documents, files)
    spark = documents.sparkSession
    # How many pairs stand in so many documents, by powers of two: a few dozen rows.
    power = F.floor(F.log2("docs")).cast("int")
    sizes = {r["power"]: r["count"] for r in counted.groupBy(power.alias("power")).count().collect()}
    least, room = None, broadcast_rows
    for p in sorted(sizes, reverse=True):
        room -= sizes[p]
        if room < 0:
            break
        least = p
    chosen = counted.where(power >= least) if least is not None else counted.limit(0)
    common = chosen.select("pair", "docs", "best").toArrow()  # at most broadcast_rows rows
    columns = [common.column(c).to_numpy() for c in ("pair", "docs", "best")]
    order = np.argsort(columns[0])
    sent = spark.sparkContext.broadcast(tuple(c[order] for c in columns))
    made = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    given = texts.select(F.struct("row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.monotonically_increasing_id().alias("id")).alias("made"), "a", "b", "g")
    looked = StructType([given.schema["made"], *StructType.fromDDL("n_best long, count_sum long, others array<struct<pair: long, links: long>>")])
    out = mapped(given, _looked_up(sent, vocabulary), looked)
    if sum(sizes.values()) > common.num_rows:
        out = checkpointed(out)
        others = out.select(F.col("made.id").alias("id"), F.explode("others").alias("o")).select("id", "o.pair", "o.links")
        rest = others.join(counted.where(power < least if least is not None else F.lit(True)), "pair").groupBy("id").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("docs")).alias("more_sum"))
        more = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
        out = out.join(rest, F.col("made.id") == F.col("id"), "left").select("made", more("n_best", "more_best"), more("count_sum", "more_sum"))
    names = [c for c in documents.columns if c != "text"]
    taken = {c.lower() for c in names}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    value = lambda c: F.col(c) if c in ("n_best", "count_sum") else F.col("made").getField(c)
    return out.select(*(F.col("made").getField("row").getField(c).alias(c) for c in names), *(value(c).alias(free(c)) for c in made))
