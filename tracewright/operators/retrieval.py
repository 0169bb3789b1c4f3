"""Ranked retrieval: exact top-k, over-fetch, filters, boosts and source-type diversity.

Chunks have id, embedding, source_type, source; queries have query_id and
vector. The unit is a batch of queries: blocks of queries meet blocks of
chunks, a task gives its own best k of each query, and a window ranks those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..session import importable

#: Rows of a block, of queries or of chunks.
BLOCK = 10_000

#: Over-fetch factors and the floor of reserved slots.
OVERFETCH_SIGNALS, OVERFETCH_FILTERS, RESERVE_FLOOR = 3, 10, 0.65
SIGNAL_WEIGHT = 0.2


def ranked(scored: DataFrame, k: int, score: str = "score", order: str = "id") -> DataFrame:
    """The k best rows of each query, ties by ``order``; ``rank`` counts from 1."""
    best = Window.partitionBy("query_id").orderBy(F.col(score).desc(), F.col(order))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best(ids: np.ndarray, scores: np.ndarray, group: np.ndarray | None, k: int) -> np.ndarray:
    """Places of the k best scores of each group, ties by id."""
    if k == 0:
        return np.zeros(0, np.int64)
    if group is None and len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= floor)
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    if group is None:
        return np.lexsort((ids, -scores))[:k]
    order = np.lexsort((ids, -scores, group))
    start = np.r_[True, group[order][1:] != group[order][:-1]]
    place = np.arange(len(order))
    return order[place - np.maximum.accumulate(np.where(start, place, 0)) < k]


def vectors_of(column: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
    """The rows ``at`` of a column of vectors; of unlike lengths it is an error."""
    lists = column.take(pa.array(at)).combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(size) and (size != size[0]).any():
        raise ValueError("dimension mismatch")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)


def best_of_blocks(queries: DataFrame, chunks: DataFrame, keys: list[str], k: int, by: str | None = None) -> DataFrame:
    """The k best chunks of each query (and value of ``by``) within each block; blocks are equal ``keys``.

    queries: keys, query_id, vector and floor (null, or the score below which
    nothing counts); chunks: keys, id, embedding and others, which stay. A
    task holds one block of both sides; the caller bounds it.
    """
    importable(chunks.sparkSession)
    kept = [f for f in chunks.schema.fields if f.name not in ("embedding", *keys)]
    row = F.struct(*(F.col(f"`{f.name}`") for f in kept))
    name = queries.schema["query_id"].dataType
    left = queries.select(*keys, F.lit(True).alias("asks"), F.col("vector").cast("array<double>").alias("vector"), "query_id", F.col("floor").cast("double").alias("floor"))
    right = chunks.select(*keys, F.lit(False).alias("asks"), F.col("embedding").cast("array<double>").alias("vector"), F.lit(None).cast(name).alias("query_id"), F.lit(None).cast("double").alias("floor"), row.alias("row"))
    left = left.withColumn("row", F.lit(None).cast(right.schema["row"].dataType))

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        rows = table.column("row").combine_chunks().take(pa.array(c))
        names, floors = table.column("query_id").take(pa.array(q)), np.nan_to_num(table.column("floor").to_numpy()[q].astype(np.float64), nan=-np.inf)
        at, asked, found = [], [], []
        if len(q) and len(c):
            m, v = vectors_of(table.column("vector"), c), vectors_of(table.column("vector"), q)
            if m.shape[1] != v.shape[1]:
                raise ValueError("dimension mismatch")
            ids = rows.field("id").to_numpy(zero_copy_only=False)
            group = np.unique(rows.field(by).to_numpy(zero_copy_only=False), return_inverse=True)[1] if by else None
            length, own = np.sqrt((m * m).sum(1)), np.sqrt((v * v).sum(1))
            for low in range(0, len(q), 128):
                both = own[low : low + 128, None] * length[None, :]
                scores = np.divide(v[low : low + 128] @ m.T, both, out=np.zeros_like(both), where=both > 0)
                for i in range(len(scores)):
                    best = _best(ids, scores[i], group, k)
                    best = best[scores[i, best] >= floors[low + i]]
                    at.append(best)
                    asked.append(np.full(len(best), low + i))
                    found.append(scores[i, best])
        at, asked = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, asked))
        taken = rows.take(pa.array(at))
        columns = {f.name: taken.field(f.name) for f in kept}
        return pa.table(columns | {"query_id": names.take(pa.array(asked)), "score": np.concatenate(found) if found else np.zeros(0)})

    schema = StructType([*kept, StructField("query_id", name), StructField("score", DoubleType())])
    return left.unionByName(right).groupBy(*keys).applyInArrow(run, schema)


def top_k(queries: DataFrame, chunks: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """query_id, id, score, rank and the chunk's other columns: the k most alike chunks by cosine, of each value of ``by`` if given.

    k <= 0 gives no rows; a zero vector is alike to nothing (0); vectors of
    unlike length raise an error. Both sides are dealt into blocks of at most
    some BLOCK rows by their counts; every pair of blocks meets in one task,
    which gives its own best k of each query, and a window ranks those. No
    vector passes through the driver. ``index.VectorIndex`` skips blocks.
    """
    chunks, wanted = chunks.where("embedding is not null"), queries.select("query_id", "vector").where("vector is not null")
    if k <= 0:
        return chunks.drop("embedding").select("*", F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    x, y = (max(1, -(-side.count() // BLOCK)) for side in (wanted, chunks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = wanted.withColumn("_x", deal("query_id", x)).withColumn("_y", every(y)).withColumn("floor", F.lit(None).cast("double"))
    right = chunks.withColumn("_y", deal("id", y)).withColumn("_x", every(x))
    scored = best_of_blocks(left, right, ["_x", "_y"], k, by)
    if by is None:
        return ranked(scored, k)
    best = Window.partitionBy("query_id", by).orderBy(F.col("score").desc(), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def filled(of_type: DataFrame, kind: str, most: int) -> DataFrame:
    """``place`` from 1 of each query's rows (ranked within their type), types in order of their best score; at most ``most``."""
    best = F.max("score").over(Window.partitionBy("query_id", kind))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("best").desc(), kind, "rank"))
    return of_type.withColumn("best", best).withColumn("place", place).where(F.col("place") <= most).drop("best")


def fetch_size(k: int, signals: bool = False, reranked: bool = False, boosts: bool = False, filters: bool = False, diverse: bool = False) -> int:
    return max(k, k * OVERFETCH_SIGNALS if signals or reranked else 0, k * OVERFETCH_FILTERS if boosts or filters or diverse else 0)


def allowed(source_type: Column, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Query filters: exclusion wins, an empty list is no filter, a missing type is ``unknown``."""
    kind = F.coalesce(source_type, F.lit("unknown"))
    out = F.lit(True)
    if include:
        out = out & kind.isin(include)
    if exclude:
        out = out & ~kind.isin(exclude)
    return out


def trace_allowed(source_type: Column, include: list[str] | None, exclude: list[str] | None) -> Column:
    """Trace filters: an include list, even an empty one, decides alone."""
    if include is not None:
        return source_type.isin(include) if include else F.lit(False)
    return ~source_type.isin(exclude) if exclude else F.lit(True)


def composite(base: Column, signal: Column | None, type_boosts: dict[str, float] | None, source_type: Column, level_boosts: dict[str, float] | None = None, level: Column | None = None) -> Column:
    """base * (1 + signal / 100 * 0.2) * type boost * level boost; missing boosts are 1, the default level is ``symbol``."""
    out = base
    if signal is not None:
        out = out * (1 + F.coalesce(signal, F.lit(0.0)) / 100 * SIGNAL_WEIGHT)
    for boosts, key in ((type_boosts, source_type), (level_boosts, F.coalesce(level, F.lit("symbol")) if level is not None else F.lit("symbol"))):
        if boosts:
            pairs = F.create_map(*(F.lit(x) for kv in boosts.items() for x in kv))
            out = out * F.coalesce(F.try_element_at(pairs, key), F.lit(1.0))
    return out


def diversified(scored: DataFrame, k: int, floor: float = RESERVE_FLOOR) -> DataFrame:
    """Top k with a slot for the best of each source type whose retrieval score reaches ``floor`` of the query's top.

    ``scored`` has query_id, id, source_type, retrieval and score. The rest is
    filled by score; ``promoted`` marks rows that the plain top k would lack.
    """
    of_query = Window.partitionBy("query_id")
    order = [F.col("score").desc(), F.col("id")]
    by_type = Window.partitionBy("query_id", "source_type").orderBy(*order)
    plain = of_query.orderBy(*order)
    marked = scored.withColumn("top", F.max("retrieval").over(of_query)).withColumn("of_type", F.row_number().over(by_type)).withColumn("plain", F.row_number().over(plain))
    marked = marked.withColumn("reserved", (F.col("of_type") == 1) & (F.col("retrieval") >= floor * F.col("top")))
    kept = marked.withColumn("slot", F.row_number().over(of_query.orderBy(F.col("reserved").desc(), *order))).where(F.col("slot") <= k)
    out = kept.withColumn("rank", F.row_number().over(plain)).withColumn("promoted", F.col("plain") > k)
    return out.drop("top", "of_type", "plain", "reserved", "slot")


def search(queries: DataFrame, chunks: DataFrame, k: int = 10, include: list[str] | None = None, exclude: list[str] | None = None, type_boosts: dict[str, float] | None = None, min_score: float = 0.0, diverse: bool = False, signal: str | None = None, prefilter: bool = False) -> DataFrame:
    """The whole query: over-fetch, filter, floor, composite score, diversity, slice.

    Filters run after the over-fetch (a filter below it would see more rows);
    ``prefilter`` puts them first, which changes results on purpose.
    """
    n = fetch_size(k, signals=signal is not None, boosts=bool(type_boosts), filters=bool(include or exclude), diverse=diverse)
    kind = F.col("source_type")
    if prefilter:
        chunks = chunks.where(allowed(kind, include, exclude))
    rows = top_k(queries, chunks, n).withColumnRenamed("score", "retrieval").withColumnRenamed("rank", "fetched")
    rows = rows.where(allowed(kind, include, exclude) & (F.col("retrieval") >= min_score))
    scored = rows.withColumn("score", composite(F.col("retrieval"), F.col(signal) if signal else None, type_boosts, kind))
    if diverse:
        return diversified(scored, k)
    return ranked(scored, k) if signal or type_boosts else ranked(scored, k, "retrieval")


def passthrough_rerank(candidates: DataFrame) -> DataFrame:
    """A reranker that keeps the order: score n - i for the i-th candidate of a query."""
    w = Window.partitionBy("query_id")
    return candidates.withColumn("rerank", (F.count("*").over(w) - F.col("rank") + 1).cast("double"))
