"""A kept vector index: cells around pivots on disk, upserts, exact top-k that skips cells.

Each vector belongs to the cell of the pivot it is most alike to. A cell
remembers the least and the greatest angle between its members and its pivot;
by the triangle inequality no member is closer to a query than the difference
of angles allows. A search visits each query's most promising cells first,
until they hold k rows; the k-th score found there rules out every cell whose
bound is below it, and the rest is visited. The result is that of a full
scan, whatever the data; how much is skipped depends on how well the cells
separate them.

An index is a folder. Pivots are fixed when it is made, from a sample that
``cells`` bounds. Every change is a segment of its own, partitioned by cell
and read once Spark has marked it as whole; the last segment with an id wins
and ``compact`` makes one of all. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType
from pyspark.sql.window import Window

from ..session import checkpointed, importable, sized
from .retrieval import BLOCK, best_of_blocks, ranked
from .store import Conflict, _files

#: The most pivots; the cell of zero vectors, which are alike to nothing.
CELLS, ZERO = 4096, -1
#: What rounding can add to an angle.
SLACK = 1e-7


class DimensionMismatch(ValueError):
    """Vectors of another length than the index has."""


def sample_pivots(rows: DataFrame, most: int) -> DataFrame:
    """(cell, vector): the unit vectors of ``most`` ids that a hash picks."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.select("id", F.col("embedding").cast("array<double>").alias("v")).withColumn("n", norm).where("n > 0").withColumn("v", F.transform("v", lambda x: x / F.col("n")))
    order = [F.xxhash64("id"), F.col("id")]
    picked = unit.orderBy(*order).limit(most).withColumn("cell", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    return picked.select("cell", F.col("v").alias("vector"))


def placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` with their ``cell``, that of the most alike pivot, and their ``angle`` to it; zero vectors have the cell ZERO."""
    importable(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(pivots)  # CELLS vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent.value
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                m = part.column("_v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                length = np.sqrt((m * m).sum(1))
                cosines = (m / np.maximum(length, 1e-300)[:, None]) @ pivots.T if len(pivots) else np.zeros((len(m), 1))
                cell = cosines.argmax(1)
                angle = np.arccos(np.clip(cosines[np.arange(len(m)), cell], -1, 1))
                zero = length == 0
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(np.where(zero, ZERO, cell).astype(np.int32)), pa.array(np.where(zero, 0.0, angle))], names=["row", "cell", "angle"])

    given = rows.select(F.struct("*").alias("row"), F.col("embedding").cast("array<double>").alias("_v"))
    schema = StructType().add("row", given.schema["row"].dataType).add("cell", IntegerType()).add("angle", DoubleType())
    return given.mapInArrow(run, schema).select("row.*", "cell", "angle")


def bounds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cells of placed rows, their least and greatest angles and their sizes: one row a cell."""
    found = rows.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).orderBy("cell").collect()
    return tuple(np.array([r[c] for r in found], t) for c, t in (("cell", np.int64), ("low", float), ("high", float), ("n", np.int64)))


class VectorIndex:
    """The index in a folder; ``create`` makes one, the constructor opens it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        rows = spark.read.parquet(f"{self.folder}/pivots").orderBy("cell").collect()  # CELLS rows at most
        self.pivots = np.array([r["vector"] for r in rows], np.float64)

    @classmethod
    def create(cls, chunks: DataFrame, folder: str, cells: int | None = None, order: str | None = None) -> VectorIndex:
        """An index of ``chunks`` (id, embedding and others). Pivots are the vectors of ``cells`` ids that a hash picks: the root of the number of rows, CELLS at most."""
        spark, rows = chunks.sparkSession, chunks.where("embedding is not null")
        n = rows.count()
        most = min(cells or max(1, int(n**0.5)), CELLS)
        least, greatest = cls._sizes(rows, "embedding")
        if least != greatest:
            raise DimensionMismatch(f"{least} and {greatest}")
        sample_pivots(rows, most).write.parquet(f"{folder.rstrip('/')}/pivots")
        index = cls(spark, folder)
        index.upsert(chunks, order)
        return index

    # -- segments ----------------------------------------------------------

    @staticmethod
    def _sizes(rows: DataFrame, column: str) -> tuple[int | None, int | None]:
        sizes = rows.agg(F.min(F.size(column)).alias("least"), F.max(F.size(column)).alias("greatest")).first()
        return sizes["least"], sizes["greatest"]

    def _guard(self, rows: DataFrame, column: str) -> None:
        least, greatest = self._sizes(rows, column)
        if least is not None and len(self.pivots) and not least == greatest == self.pivots.shape[1]:
            raise DimensionMismatch(f"the index has {self.pivots.shape[1]}, rows have {least} to {greatest}")

    def segments(self) -> list[int]:
        """The numbers of whole segments, rising; those before a compacted one are gone."""
        files, at = _files(self.spark, f"{self.folder}/segments")
        if not files.exists(at):
            return []
        whole = [f.getPath().getName() for f in files.listStatus(at) if files.exists(_files(self.spark, f"{f.getPath()}/_SUCCESS")[1])]
        base = max((int(n.partition("-")[0]) for n in whole if n.endswith("-base")), default=0)
        return sorted(int(n.partition("-")[0]) for n in whole if int(n.partition("-")[0]) >= base)

    def _path(self, number: int) -> str:
        base = f"{self.folder}/segments/{number:09d}-base"
        files, at = _files(self.spark, f"{base}/_SUCCESS")
        return base if files.exists(at) else f"{self.folder}/segments/{number:09d}"

    def _append(self, rows: DataFrame, number: int | None = None, name: str = "") -> int:
        number = number or max(self.segments(), default=0) + 1
        target = f"{self.folder}/segments/{number:09d}{name}"
        files, at = _files(self.spark, f"{target}/_SUCCESS")
        if files.exists(at):
            raise Conflict(f"segment {number} exists")
        # Ranges of (cell, id): a cell with many rows is several files, a task writes few cells.
        rows.repartitionByRange("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(target)
        return number

    def upsert(self, chunks: DataFrame, order: str | None = None) -> int:
        """Add rows or put them in the place of those with their ids; of several with one id the last by ``order`` (without: any). Returns the segment's number."""
        rows = chunks.where("embedding is not null")
        self._guard(rows, "embedding")
        if order is not None:
            last = Window.partitionBy("id").orderBy(F.col(order).desc())
            rows = rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
        else:
            rows = rows.dropDuplicates(["id"])
        return self._append(placed(rows, self.pivots).withColumn("gone", F.lit(False)))

    def delete(self, ids: DataFrame) -> int:
        """Take the rows with these ids out."""
        like = self._read(self.segments()[-1])
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields if f.name not in ("id", "cell", "gone")]
        return self._append(ids.select("id").distinct().select("id", *none, F.lit(ZERO).alias("cell"), F.lit(True).alias("gone")))

    def _read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(self._path(number))

    def live(self) -> DataFrame:
        """The rows of the index with ``cell`` and ``angle``. Ids are compared only where a later segment exists."""
        out, later = None, None
        for number in reversed(self.segments()):
            segment = self._read(number)
            rows = segment if later is None else segment.join(later, "id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
            later = segment.select("id") if later is None else later.union(segment.select("id"))
        return out.where("not gone").drop("gone")

    def compact(self) -> None:
        """One segment of all live rows; it takes the number after the last and replaces those before."""
        self._append(self.live().withColumn("gone", F.lit(False)), max(self.segments()) + 1, "-base")

    def size(self) -> int:
        return self.live().count()

    # -- search ------------------------------------------------------------

    def _cells(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cells with their least and greatest angle and their rows, from the segments without comparing ids: overwritten rows only widen a cell."""
        parts = [self._read(n).where("not gone").select("cell", "angle") for n in self.segments()]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.union(p)
        return bounds(rows)

    def _wanted(self, queries: DataFrame, k: int, first: bool) -> DataFrame:
        """(query_id, vector, floor, cell): the cells that hold a query's first k rows, or those left that its floor does not rule out."""
        sent = self.spark.sparkContext.broadcast((self.pivots, self._cells()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, (cells, low, high, n) = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    v = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    length = np.sqrt((v * v).sum(1))
                    own = np.maximum(cells, 0)
                    angle = np.arccos(np.clip((v / np.maximum(length, 1e-300)[:, None]) @ pivots.T, -1, 1))[:, own] if len(pivots) else np.zeros((len(v), len(cells)))
                    bound = np.cos(np.maximum(np.maximum(angle - high, low - angle) - SLACK, 0))
                    bound[:, cells == ZERO] = 0.0
                    bound[length == 0] = 0.0
                    order = np.argsort(-bound, axis=1, kind="stable")
                    held = np.cumsum(n[order], axis=1) - n[order]
                    start = np.zeros(bound.shape, bool)
                    np.put_along_axis(start, order, held < k, 1)
                    floor = np.nan_to_num(part.column("floor").to_numpy(zero_copy_only=False).astype(np.float64), nan=-np.inf)
                    q, c = np.nonzero(start if first else ~start & (bound >= floor[:, None]))
                    rows = part.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([rows.column("query_id"), rows.column("vector"), rows.column("floor"), pa.array(cells[c].astype(np.int32)), pa.array(n[c])], names=["query_id", "vector", "floor", "cell", "members"])

        schema = StructType([*queries.select("query_id", "vector", "floor").schema.fields]).add("cell", IntegerType()).add("members", LongType())
        return queries.select("query_id", "vector", "floor").mapInArrow(run, schema)

    def _visited(self, wanted: DataFrame, k: int) -> DataFrame:
        """The best rows of the wanted cells, by blocks: a cell's rows and a cell's queries are dealt by their counts."""
        asked = wanted.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("x"), F.ceil(F.max("members") / BLOCK).cast("int").alias("y"))
        asked = sized(checkpointed(asked), 1)  # one row a cell
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        left = wanted.join(asked, "cell").select("query_id", "vector", "floor", "cell", deal("query_id", "x").alias("_x"), every("y").alias("_y"))
        right = self.live().drop("angle").join(asked, "cell").withColumn("_y", deal("id", "y")).withColumn("_x", every("x")).drop("x", "y")
        return best_of_blocks(left, right, ["cell", "_x", "_y"], k)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, score, rank and the other columns of the k rows most alike to each query (query_id, vector), ties by id: what a full scan gives."""
        return self._searched(queries, k)[0]

    def _searched(self, queries: DataFrame, k: int) -> tuple[DataFrame, list[DataFrame]]:
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(None).cast("double").alias("floor")).where("vector is not null")
        self._guard(asked, "vector")
        first = checkpointed(self._wanted(asked, max(k, 0), True))
        best = checkpointed(ranked(self._visited(first, max(k, 0)), max(k, 0)))
        floors = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("found"))
        rest = checkpointed(self._wanted(asked.join(floors, "query_id", "left").select("query_id", "vector", F.col("found").alias("floor")), max(k, 0), False))
        return ranked(best.drop("rank").unionByName(self._visited(rest, max(k, 0))), max(k, 0)), [first, rest]

    def visits(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, visited, share): how many rows a search compares each query with, and which part of the index that is."""
        first, rest = self._searched(queries, k)[1]
        total = self.size()
        return first.unionByName(rest).groupBy("query_id").agg(F.sum("members").alias("visited")).withColumn("share", F.col("visited") / max(total, 1))

    # -- exchange ----------------------------------------------------------

    def write_json(self, path: str) -> None:
        """The live rows as JSON lines, without cells."""
        self.live().drop("cell", "angle").write.json(path)

    @classmethod
    def read_json(cls, spark: SparkSession, path: str, schema: StructType | str, folder: str, cells: int | None = None) -> VectorIndex:
        """A new index in ``folder`` of rows that ``write_json`` wrote; vectors of unlike length are an error."""
        return cls.create(spark.read.schema(schema).json(path), folder, cells)
