"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

A text gets a leading space and its spaces become the marker U+2581. No piece
has a marker behind another character, so the best segmentation of a text is
the best one of each stretch "spaces, then other characters"; a stretch is
segmented once and remembered (a bounded memory), and all new stretches of a
batch go through the trie together. Characters that no piece covers, and the
marker itself where a text holds it, become byte pieces, so decoding gives
the text back exactly.

The vocabulary file is read on the driver and its pieces are broadcast (their
number is fixed by the file). A Unigram model's scores are used as they are;
a BPE model has ranks only, and rank r stands for the log score -ln(r + 2).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .common import mapped

MARK = "▁"
_MARK = MARK.encode()
#: Stretches that are remembered, and the longest that is (in characters).
MEMORY, LONGEST = 250_000, 256
_STRETCH = re.compile(" +[^ ]*|[^ ]+")


class DoubleArray:
    """A trie of byte strings in two arrays: node n goes on byte b to base[n] + b + 1 if check there is n."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 12
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        search = {}  # for each number of children, where the last search ended: places before it are taken or were tried
        todo = [(0, 0, len(order), 0)]  # node, first and last key, depth
        while todo:
            node, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[order[lo]]) == depth:
                value[node] = order[lo]
                lo += 1
            if lo == hi:
                continue
            groups, start = [], lo
            for k in range(lo, hi):
                if keys[order[k]][depth] != keys[order[start]][depth]:
                    groups.append((keys[order[start]][depth], start, k))
                    start = k
            groups.append((keys[order[start]][depth], start, hi))
            codes = np.array([g[0] + 1 for g in groups])
            at = search.get(min(len(codes), 32), 1)
            while True:
                if at + 1024 > len(check):
                    base, check, value = (np.concatenate([x, np.full(len(x), fill, np.int64)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                # The first place of the next 512 where all children fit.
                fits = (check[at + np.arange(512)[:, None] + codes] == -1).all(1)
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += 512
            search[min(len(codes), 32)] = at
            base[node] = at
            check[at + codes] = node
            todo += [(at + code + 1, a, b, depth + 1) for code, a, b in groups]
        used = int(np.flatnonzero(check != -1).max()) + 300
        self.base, self.check, self.value = base[:used], check[:used], value[:used]


class Pieces:
    """A vocabulary: pieces with ids and log scores, and the ids of the 256 byte pieces."""

    def __init__(self, pieces: list[tuple[int, str, float]], byte_ids: list[int]):
        self.ids = np.array([p[0] for p in pieces], np.int32)
        self.scores = np.array([p[2] for p in pieces])
        self.trie = DoubleArray([p[1].encode() for p in pieces])
        self.unknown = float(self.scores.min()) - 10.0
        self.byte_ids = np.array(byte_ids, np.int32)
        if any(MARK in p.lstrip(MARK) for _, p, _ in pieces):
            raise ValueError("a piece has a marker behind another character: stretches can't be segmented alone")
        spans = {int(i): p.replace(MARK, " ").encode() for i, p, _ in pieces} | {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
        n = max(spans) + 1
        spans[n] = "\ufffd".encode()  # what an id that the vocabulary lacks stands for
        self.other, n = n, n + 1
        self.span_len = np.array([len(spans.get(i, b"")) for i in range(n)], np.int64)
        self.span_at = np.r_[0, np.cumsum(self.span_len)[:-1]]
        self.span = np.frombuffer(b"".join(spans.get(i, b"") for i in range(n)), np.uint8)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """A vocabulary file of the SentencePiece format."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(m.get_piece_size())
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = [i for i in every if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        raw = [m.get_score(i) for i in plain]
        ranked = min(raw) < -1000  # no log probability is as low: these are a BPE model's ranks
        scores = [-float(np.log(2 - s)) for s in raw] if ranked else raw
        return cls([(i, m.id_to_piece(i), s) for i, s in zip(plain, scores, strict=True)], byte_ids)

    def one(self, text: bytes) -> list[int]:
        """The ids of one marked stretch, position by position."""
        n = len(text)
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        base, check, value = self._lists()
        for i in range(n):
            if best[i] == -np.inf:
                continue
            b = text[i]
            width = 1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            node, single = 0, False
            for j in range(i, n):
                t = base[node] + text[j] + 1
                if check[t] != node:
                    break
                node = t
                if value[t] >= 0:
                    single |= j + 1 - i == width
                    s = best[i] + self.scores[value[t]]
                    if s > best[j + 1]:
                        best[j + 1], back[j + 1] = s, (i, value[t])
            end = min(i + width, n)
            if not single and best[i] + self.unknown > best[end]:
                best[end], back[end] = best[i] + self.unknown, (i, -1)
        out, j = [], n
        while j > 0:
            i, v = back[j]
            out += [int(self.ids[v])] if v >= 0 else [int(self.byte_ids[b]) for b in reversed(text[i:j])]
            j = i
        return out[::-1]

    def _lists(self):
        if not hasattr(self, "_as_lists"):
            self._as_lists = self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist()
        return self._as_lists

    def many(self, texts: list[bytes]) -> list[bytes]:
        """The packed ids of many short stretches, all at once: same rule as ``one``."""
        size = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8).astype(np.int64)
        first = np.r_[0, np.cumsum(size)[:-1]]
        cell = first + np.arange(len(texts))  # a stretch of n bytes has n + 1 cells
        best = np.full(int(size.sum()) + len(texts), -np.inf)
        back, via = np.zeros(len(best), np.int64), np.full(len(best), -1, np.int64)
        best[cell] = 0.0
        order = np.argsort(-size, kind="stable")
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        rising = np.sort(size)
        for p in range(int(size.max(initial=0))):
            w = order[: len(size) - np.searchsorted(rising, p, "right")]
            w = w[best[cell[w] + p] > -np.inf]
            lead = data[first[w] + p]
            width = np.where(lead < 0xC0, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            width = np.minimum(width, size[w] - p)
            single = np.zeros(len(w), bool)
            node, live, d = np.zeros(len(w), np.int64), np.arange(len(w)), 0
            while len(live):
                go = base[node] + data[first[w[live]] + p + d] + 1
                ok = check[go] == node
                live, node = live[ok], go[ok]
                d += 1
                ends = value[node] >= 0
                at = live[ends]
                if len(at):
                    single[at] |= width[at] == d
                    v = value[node[ends]]
                    s = best[cell[w[at]] + p] + self.scores[v]
                    target = cell[w[at]] + p + d
                    better = s > best[target]
                    target = target[better]
                    best[target], back[target], via[target] = s[better], p, v[better]
                room = p + d < size[w[live]]
                live, node = live[room], node[room]
            at = np.flatnonzero(~single)
            s = best[cell[w[at]] + p] + self.unknown
            target = cell[w[at]] + p + width[at]
            better = s > best[target]
            target = target[better]
            best[target], back[target], via[target] = s[better], p, -1
        out, back, via = [], back.tolist(), via.tolist()
        ids, byte_ids = self.ids.tolist(), self.byte_ids.tolist()
        for t, c, n in zip(texts, cell.tolist(), size.tolist(), strict=True):
            path, j = [], n
            while j > 0:
                i, v = back[c + j], via[c + j]
                path += [ids[v]] if v >= 0 else [byte_ids[b] for b in reversed(t[i:j])]
                j = i
            out.append(np.array(path[::-1], np.int32).tobytes())
        return out

    def encode(self, texts: list[str], memory: dict[str, bytes]) -> list[bytes]:
        """The packed ids of each text. An empty text has none."""
        cut = [_STRETCH.findall(" " + t) if t else [] for t in texts]
        new = list({s for stretches in cut for s in stretches if len(s) <= LONGEST} - memory.keys())
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            plain = [s for s in part if MARK not in s]
            memory.update(zip(plain, self.many([s.replace(" ", MARK).encode() for s in plain]), strict=True))
            memory.update((s, self._long(s)) for s in part if MARK in s)
        out = [b"".join([memory[s] if len(s) <= LONGEST else self._long(s) for s in stretches]) for stretches in cut]
        if len(memory) > MEMORY:  # full: the first ones, among them the frequent ones, stay
            for s in new:
                del memory[s]
        return out

    def _long(self, stretch: str) -> bytes:
        """A long stretch, or one in which the marker itself stands (it becomes three bytes)."""
        parts = [self.one(p.replace(" ", MARK).encode()) for p in stretch.split(MARK)]
        mark = [int(self.byte_ids[b]) for b in _MARK]
        joined = [i for k, p in enumerate(parts) for i in ([*mark, *p] if k else p)]
        return np.array(joined, np.int32).tobytes()

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts, each without the space that its first marker stands for; an unknown id becomes U+FFFD."""
        ids = np.where((ids >= 0) & (ids < self.other), ids, self.other)
        sizes = self.span_len[ids]
        ends = np.cumsum(sizes)
        data = self.span[np.repeat(self.span_at[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))] if len(ids) else np.zeros(0, np.uint8)
        cuts = np.r_[0, ends][offsets]
        some = np.diff(cuts) > 0
        some[some] = data[cuts[:-1][some]] == 0x20
        keep = np.ones(len(data), bool)
        keep[cuts[:-1][some]] = False
        return data[keep], cuts - np.r_[0, np.cumsum(some)]


def encoded(documents: DataFrame, pieces: Pieces, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids and round_trip of each row; with ``decoded`` all columns, and ``text`` is the decoded one.

    A null or empty text has no tokens and decodes to the empty text.
    Repeated rows are encoded alike. A column that has the name of one of the
    made ones gives way to it.
    """
    sent = documents.sparkSession.sparkContext.broadcast(pieces)
    made_names = ("n_tokens", "n_byte_tokens", "ids", "round_trip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        is_byte = np.zeros(len(model.span_len), bool)
        is_byte[model.byte_ids] = True
        memory: dict[str, bytes] = {}
        for batch in batches:
            column = batch.column("text").fill_null("")
            for i, j, data, offsets in K.slices(column):
                n = j - i
                packed = model.encode(column.slice(i, n).to_pylist(), memory)
                ids = np.frombuffer(b"".join(packed), np.int32)
                at = np.r_[0, np.cumsum([len(x) // 4 for x in packed])].astype(np.int32)
                back, cuts = model.decode(ids, at)
                whole = np.diff(cuts) == np.diff(offsets)
                if whole.all():
                    wrong = np.flatnonzero(back != data)
                    whole[np.searchsorted(offsets, wrong, "right") - 1] = False
                else:
                    whole &= [back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(cuts, cuts[1:], offsets, offsets[1:], strict=False)]
                bytes_ = np.r_[0, np.cumsum(is_byte[ids])][at]
                made = [batch.column("row").slice(i, n), pa.array(np.diff(at).astype(np.int64)), pa.array(np.diff(bytes_).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), pa.array(ids)), pa.array(whole)]
                names = ["row", *made_names]
                if decoded:
                    made.append(pa.array([back[a:b].tobytes().decode() for a, b in zip(cuts, cuts[1:], strict=False)], pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(made, names=names)

    kept = [c for c in documents.columns if c != "text" and c.lower() not in made_names] if decoded else ["doc_id"]
    given = documents.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), "text")
    made = StructType.fromDDL("n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean" + (", text string" if decoded else ""))
    out = mapped(given, run, StructType([given.schema["row"], *made]))
    row = {c: F.col("row").getField(c).alias(c) for c in kept}
    if not decoded:
        return out.select(*row.values(), *made_names)
    return out.select(*(F.col("text") if c == "text" else row[c] for c in documents.columns if c == "text" or c in row), *made_names)


def decode(tokens: DataFrame, pieces: Pieces) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give the empty text, bytes that are no UTF-8 and ids that the vocabulary lacks (null ones too) the replacement character."""
    sent = tokens.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            data, cuts = sent.value.decode(lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(sizes)])
            text = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return mapped(tokens.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text string")
