"""Chat formatting: roles recovered by a hidden Markov model, then canonical turns.

States are the roles; a turn's observation is its speaker marker ("User:",
"### Assistant", "[system]", ...), its length, its number of lines and
whether it asks. Start, transition and observation probabilities are counted
over labelled conversations, with a half added (a twentieth for observations). Viterbi finds the roles; a
conversation of any length is cut into pieces of CHUNK turns, whose best-path
matrices (roles x roles) are chained first, so no task holds more than one
piece and the result is that of one long run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, mapped, remainder, sized

ROLES = ("system", "user", "assistant")
CHUNK = 512
#: Words that name a role in a marker.
_NAMES = {"system": "system|instructions?|sys", "user": "user|human|question|q|customer|me", "assistant": "assistant|ai|bot|model|answer|a|gpt|agent"}
_MARKER = r"^\s*(?:<\|(?:im_start\|>)?|#{1,4}|\*\*|\[|>)?\s*(?i:%s)\s*(?:\|>|\*\*|\])?\s*(?:[:>\-|\]]+|\*\*|$|\n)\s*(?:\*\*)?"
_OBSERVED = 4 * 8 * 3 * 2


def marker(text: Column) -> Column:
    """0 without a marker, else the number of its role from 1."""
    found = F.lit(0)
    for k, role in reversed(list(enumerate(ROLES, 1))):
        found = F.when(text.rlike(_MARKER % _NAMES[role]), k).otherwise(found)
    return found


def observation(text: Column) -> Column:
    """One number for a turn's features; null text is the empty turn."""
    t = F.coalesce(text, F.lit(""))
    size = F.least(F.floor(F.log2(F.char_length(t) + 1) * 0.72), F.lit(7)).cast("int")
    lines = F.least(F.regexp_count(t, F.lit("\n")), F.lit(2))
    return (((marker(t) * 8 + size) * 3 + lines) * 2 + t.contains("?").cast("int")).cast("int")


def unmarked(text: Column) -> Column:
    """The turn without its marker and the white space around it."""
    names = "|".join(_NAMES[r] for r in ROLES)
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _MARKER % names, ""))


def train(turns: DataFrame, allowed: Column | None = None) -> dict[str, np.ndarray]:
    """Log start, transition and observation probabilities counted over all labelled turns.

    Only counts by role pair and by (role, observation) reach the driver.
    """
    known = turns.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    if allowed is not None:
        known = known.where(allowed)
    one = known.select("conv_id", "turn", "role", observation(F.col("text")).alias("o"))
    before = one.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("before")).dropDuplicates(["conv_id", "turn"])
    rows = one.join(before, ["conv_id", "turn"], "left").groupBy("before", "role", "o").agg(F.count("*").alias("n")).collect()
    start, move, seen = np.full(3, 0.5), np.full((3, 3), 0.5), np.full((3, _OBSERVED), 0.05)
    for r in rows:
        s = ROLES.index(r["role"])
        seen[s, r["o"]] += r["n"]
        if r["before"] is None:
            start[s] += r["n"]
        else:
            move[ROLES.index(r["before"]), s] += r["n"]
    # A marker speaks for its role whether or not the labelled turns have any, and whatever the turn's length.
    per = seen.reshape(3, 4, -1).copy()
    for s in range(3):
        for m in range(1, 4):
            per[s, m] += seen[s].sum() * (0.2 if m == s + 1 else 0.00002) / per.shape[2] - 0.05  # in place of what was added
    seen = per.reshape(3, -1)
    return {"start": np.log(start / start.sum()), "move": np.log(move / move.sum(1, keepdims=True)), "seen": np.log(seen / seen.sum(1, keepdims=True))}


def viterbi(model: dict[str, np.ndarray], seen: list[int], first: np.ndarray, last: int | None = None) -> list[int]:
    """The best states of a run; ``first`` scores the first state, ``last`` fixes the last one. Ties go to the lower state."""
    if not seen:
        return []
    move, emit = model["move"], model["seen"]
    total, back = first + emit[:, seen[0]], []
    for o in seen[1:]:
        ways = total[:, None] + move
        back.append(ways.argmax(0))
        total = ways.max(0) + emit[:, o]
    state = int(total.argmax()) if last is None else last
    path = [state]
    for b in reversed(back):
        state = int(b[state])
        path.append(state)
    return path[::-1]


def best_paths(model: dict[str, np.ndarray], seen: list[int]) -> np.ndarray:
    """The score of the best run from each first state to each last one, without the first state's start."""
    out = np.where(np.eye(3, dtype=bool), model["seen"][:, seen[0]][:, None], -np.inf)
    for o in seen[1:]:
        out = (out[:, :, None] + model["move"][None]).max(1) + model["seen"][:, o][None]
    return out


def recovered(turns: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """conv_id, turn, role (recovered; any given role is not looked at), text and rendered for each row.

    A null or empty turn is an empty observation. Turns are taken in order of
    ``turn``; repeated turns are ordered by a hash of their text. Rows with a
    null conv_id are one conversation. Rows without a turn come first, in
    order of a hash of their text, which is rough where a conversation has
    more than CHUNK of them: they are dealt over pieces then. A marker in the
    text's first line is recognised and stripped.
    """
    spark = turns.sparkSession
    sent = spark.sparkContext.broadcast(model)
    rows = turns.select("conv_id", "turn", "text", observation(F.col("text")).alias("o"))
    many = rows.where("turn is null").groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK).select("of", F.ceil(F.col("n") / CHUNK).alias("shares"))
    many = checkpointed(many)
    rows = rows.join(sized(many, many.count()), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    # Without a turn: before all others, by hash and, as equal texts have equal hashes, by row.
    dealt = F.coalesce(F.floor((F.shiftrightunsigned(F.xxhash64("text"), 1) / float(1 << 63)) * F.col("shares")) * 64 + F.pmod(F.monotonically_increasing_id(), F.lit(64)), F.lit(0))
    piece = F.when(F.col("turn").isNull(), F.lit(-(1 << 60)) + dealt).otherwise(F.floor(F.col("turn") / CHUNK))
    packed = rows.groupBy("conv_id", piece.cast("long").alias("piece")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h"), "turn", "text", "o"))).alias("turns"))
    packed = checkpointed(packed)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [best_paths(sent.value, x.as_py()).ravel().tolist() for x in batch.column("seen")]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("piece"), pa.array(out, pa.list_(pa.float64()))], names=["conv_id", "piece", "matrix"])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first and last state of each piece of a conversation on its best run."""
        m = sent.value
        for batch in batches:
            conv, piece, first, last = [], [], [], []
            for c, pieces in zip(batch.column("conv_id").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                total, back = m["start"], []
                for k, p in enumerate(pieces):
                    inner = np.array(p["matrix"]).reshape(3, 3)
                    into = total[:, None] + m["move"] if k else np.where(np.eye(3, dtype=bool), total[:, None], -np.inf)
                    come = into.argmax(0)  # the state before the piece's first
                    ways = into.max(0)[:, None] + inner
                    back.append((come, ways.argmax(0)))
                    total = ways.max(0)
                state = int(total.argmax())
                for p, (come, begin) in zip(reversed(pieces), reversed(back), strict=True):
                    conv.append(c)
                    piece.append(p["piece"])
                    last.append(state)
                    first.append(int(begin[state]))
                    state = int(come[begin[state]])
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(piece, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["conv", "at", "first", "last"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            roles = []
            for x, first, last in zip(batch.column("seen"), batch.column("first").to_pylist(), batch.column("last").to_pylist(), strict=True):
                start = m["start"] if first is None else np.where(np.arange(3) == first, 0.0, -np.inf)
                roles.append([ROLES[s] for s in viterbi(m, x.as_py(), start, last)])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turns"), pa.array(roles, pa.list_(pa.string()))], names=["conv_id", "turns", "roles"])

    long = packed.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("conv"))
    cut = packed.join(long, F.col("conv_id").eqNullSafe(F.col("conv")), "left_semi").select("conv_id", "piece", F.col("turns.o").alias("seen"))
    matrix = mapped(cut, matrices, "conv_id long, piece long, matrix array<double>")
    chained = matrix.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("piece", "matrix"))).alias("pieces"))
    ends = mapped(chained, bounds, "conv long, at long, first int, last int")
    joined = packed.join(ends, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("piece") == F.col("at")), "left")
    inner = "array<struct<k:bigint,h:bigint,turn:bigint,text:string,o:int>>"
    out = mapped(joined.select("conv_id", F.col("turns").cast(inner).alias("turns"), F.col("turns.o").alias("seen"), "first", "last"), decoded, f"conv_id long, turns {inner}, roles array<string>")
    each = out.select("conv_id", F.posexplode(F.arrays_zip("turns", "roles")).alias("i", "x"))
    return each.select(
        "conv_id", F.col("x.turns.turn").alias("turn"), F.col("x.roles").alias("role"), F.col("x.turns.text").alias("text"),
        F.concat(F.lit("<|"), F.col("x.roles"), F.lit("|>\n"), unmarked(F.col("x.turns.text")), F.lit("\n<|end|>")).alias("rendered"),
    )


def transcripts(rendered: DataFrame) -> DataFrame:
    """conv_id and the rendered conversation; a conversation's turns must fit in one row."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "rendered")))
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["rendered"]), "\n").alias("transcript"))


def parse_transcript(text: Column) -> Column:
    """A raw transcript's turns: an array of texts, cut before each line that starts with a speaker marker."""
    names = "|".join(_NAMES[r] for r in ROLES)
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n(?=" + (_MARKER % names).removeprefix("^") + ")"), lambda x: F.trim(x) != "")


def from_transcripts(raw: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``recovered`` over the turns of raw transcripts (conv_id, text): cut at speaker markers, numbered from 0. A text without markers is one turn, a blank one none."""
    turns = raw.select("conv_id", F.posexplode(parse_transcript(F.col("text"))).alias("turn", "text"))
    return recovered(turns.withColumn("turn", F.col("turn").cast("long")), model)


def formatted(turns: DataFrame) -> DataFrame:
    """``recovered`` with a model counted over the conversations whose crc32(conv_id) mod 5 is not 0."""
    return recovered(turns, train(turns, remainder("conv_id", 5) != 0))
