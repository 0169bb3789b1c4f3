"""Statistics of experiments: bootstrap, Pareto fronts, coverage, gates, sampling, ranking metrics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed, importable, sized


#: Families whose differences are sent to all tasks (eight bytes each).
FAMILIES = 4_000_000


def bootstrap_deltas(pairs: DataFrame, iterations: int, most: int = FAMILIES, piece: int = 50_000) -> DataFrame:
    """(iteration, delta): the mean of b - a over n families drawn with replacement.

    pairs has n rows (pos 0..n-1, a, b). Draws come from a hash of (iteration,
    draw), the same in any engine: the first thirteen hex digits of a
    sha256, modulo n. Up to ``most`` families the differences are sent to all
    tasks as one array, and a task adds up ``piece`` draws of an iteration at
    once; beyond it draws meet the families by a join. Families without a
    difference count in n alone.
    """
    n = pairs.count()
    d = pairs.select("pos", (F.col("b") - F.col("a")).cast("double").alias("d"))
    spark = pairs.sparkSession
    if not 0 < n <= most:
        drawn = spark.range(iterations * n).select(F.floor(F.col("id") / max(n, 1)).alias("iteration"), (F.col("id") % max(n, 1)).alias("draw"))
        at = F.conv(F.substring(F.sha2(F.concat_ws(":", "iteration", "draw"), 256), 1, 13), 16, 10).cast("long") % max(n, 1)
        return drawn.withColumn("pos", at).join(d, "pos").groupBy("iteration").agg((F.sum("d") / n).alias("delta"))
    importable(spark)
    known = d.where("d is not null").toArrow()
    values, has = np.zeros(n), np.zeros(n, bool)
    values[known["pos"].to_numpy()], has[known["pos"].to_numpy()] = known["d"].to_numpy(), True
    sent = spark.sparkContext.broadcast((values, has))
    pieces = math.ceil(n / piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, has = sent.value
        own, draws = None, []
        for batch in batches:
            parts, iterated = np.divmod(batch.column("id").to_numpy(), iterations)
            sums, counts = [], []
            for part, iteration in zip(parts.tolist(), iterated.tolist(), strict=True):
                if part != own:  # neighbours are iterations of the same draws
                    own, draws = part, [b":%d" % j for j in range(part * piece, min((part + 1) * piece, n))]
                start = b"%d" % iteration
                hashes = np.frombuffer(b"".join([sha256(start + draw).digest() for draw in draws]), np.uint8).reshape(-1, 32)
                first = np.ascontiguousarray(hashes[:, :8]).view(">u8")[:, 0]
                at = ((first >> 12) % np.uint64(n)).astype(np.int64)  # 52 bits: thirteen hex digits
                sums.append(float(values[at].sum()))
                counts.append(int(np.count_nonzero(has[at])))
            yield pa.RecordBatch.from_arrays([pa.array(iterated, pa.int64()), pa.array(sums, pa.float64()), pa.array(counts, pa.int64())], names=["iteration", "d", "has"])

    tasks = max(1, min(iterations * pieces, spark.sparkContext.defaultParallelism * 8))
    parts = spark.range(0, iterations * pieces, 1, tasks).mapInArrow(run, "iteration long, d double, has long")
    return parts.groupBy("iteration").agg(F.when(F.sum("has") > 0, F.sum("d") / n).alias("delta"))


def bootstrap_summary(deltas: DataFrame, iterations: int) -> DataFrame:
    """mean, low and high (2.5 and 97.5 % by floor index) and the share of positive deltas."""
    low, high = int(0.025 * iterations), min(int(0.975 * iterations), iterations - 1)
    ordered = F.array_sort(F.collect_list("delta"))  # iterations is a parameter, some thousand at most
    return deltas.agg(F.avg("delta").alias("mean"), F.get(ordered, F.lit(low)).alias("low"), F.get(ordered, F.lit(high)).alias("high"), F.avg((F.col("delta") > 0).cast("double")).alias("p_better"))


def pareto(rows: DataFrame, key: str, quality: str, *costs: str) -> DataFrame:
    """``rows`` with ``dominators``: how many others are at least as good in quality and in all costs (null: infinite) and better in one.

    A self theta join: rows are variants of an experiment, of which there are
    some hundred; it is no operator for data. ``frontier`` is.
    """
    cost = lambda c: F.coalesce(F.col(c), F.lit(float("inf")))
    a = rows.select(key, F.col(quality).alias("q"), *(cost(c).alias(f"a{i}") for i, c in enumerate(costs)))
    b = a.select(F.col(key).alias("by"), F.col("q").alias("bq"), *(F.col(f"a{i}").alias(f"b{i}") for i in range(len(costs))))
    good, better = F.col("bq") >= F.col("q"), F.col("bq") > F.col("q")
    for i in range(len(costs)):
        good, better = good & (F.col(f"b{i}") <= F.col(f"a{i}")), better | (F.col(f"b{i}") < F.col(f"a{i}"))
    beaten = a.join(b, good & better).groupBy(key).agg(F.count("*").alias("dominators"))
    return rows.join(beaten, key, "left").withColumn("dominators", F.coalesce("dominators", F.lit(0)))


def frontier(rows: DataFrame, quality: str, cost: str) -> DataFrame:
    """``rows`` that no other dominates in quality and one cost (null: infinite), by a sweep over ranges.

    Rows are dealt by ranges of falling quality. A row is beaten by a cheaper
    one of higher quality, or as good a one of lower cost: the least cost of
    the ranges before (one number a range) and of the rows before in its own
    range tell. Distinct (quality, cost) pairs are swept, so ties are few.
    """
    c = F.coalesce(F.col(cost).cast("double"), F.lit(float("inf")))
    points = rows.where(F.col(quality).isNotNull()).groupBy(F.col(quality).alias("_q")).agg(F.min(c).alias("_c"))
    ranged = checkpointed(points.repartitionByRange(F.col("_q").desc()).withColumn("_part", F.spark_partition_id()))
    least = ranged.groupBy("_part").agg(F.min("_c").alias("_least"))
    before = F.min("_least").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    heads = F.broadcast(least.select("_part", before.alias("_before")))  # a row a range
    own = F.min("_c").over(Window.partitionBy("_part").orderBy(F.col("_q").desc()).rowsBetween(Window.unboundedPreceding, -1))
    kept = ranged.withColumn("_own", own).join(heads, "_part").where(F.least("_own", "_before").isNull() | (F.col("_c") < F.least("_own", "_before")))
    return rows.withColumn("_c", c).join(kept.select(F.col("_q"), F.col("_c").alias("_m")), (F.col(quality) == F.col("_q")) & (F.col("_c") == F.col("_m")), "left_semi").drop("_c")


def positions(rows: DataFrame, value: str, *by: str, ranges: int = 64) -> DataFrame:
    """``rows`` with ``_i`` (place from 1 within ``by`` in rising order of a value) and ``_n`` (how many the group has).

    A group is cut at its approximate quantiles; rows are ranked within a
    range and ranges are added up from a small table, so no task sorts a
    whole group. Rows without a value have none of both and are left out.
    """
    rows = rows.where(F.col(value).isNotNull()).withColumn("_key", F.struct(*by) if by else F.lit(0))
    quantiles = [i / ranges for i in range(1, ranges)]
    cuts = checkpointed(rows.groupBy("_key").agg(F.percentile_approx(value, quantiles, 10 * ranges).alias("_cuts"), F.count("*").alias("_n")))
    dealt = rows.join(sized(cuts), "_key").withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sizes = dealt.groupBy("_key", "_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = checkpointed(sizes.select("_key", "_range", before.alias("_before")))
    place = F.row_number().over(Window.partitionBy("_key", "_range").orderBy(value))
    return dealt.join(sized(starts), ["_key", "_range"]).withColumn("_i", F.col("_before") + place).drop("_key", "_range", "_before")


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """For each name the exact percentile at its share: between the values at the places around (n - 1) * share, in proportion.

    Places come from ``positions``: no task and no buffer holds a group's values.
    """
    ranked = positions(rows, value, *by)
    out = []
    for name, share in shares.items():
        at = (F.col("_n") - 1) * F.lit(share) + 1
        low = F.floor(at)
        weight = F.when(F.col("_i") == low, 1 - (at - low)).when(F.col("_i") == low + 1, at - low)
        out.append(F.sum(F.col(value) * weight).alias(name))
    return ranked.groupBy(*by).agg(*out)


def gini(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """sum((2i - n - 1) x) / (n sum x) over values in rising order."""
    ranked = positions(rows, value, *by)
    return ranked.groupBy(*by).agg((F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col(value)) / F.nullif(F.max("_n") * F.sum(value), F.lit(0))).alias("gini"))


def trimmed_mean(rows: DataFrame, value: str, share: float, *by: str) -> DataFrame:
    """The mean without floor(share * n) rows at each end."""
    ranked = positions(rows, value, *by)
    cut = F.floor(F.col("_n") * share)
    return ranked.where((F.col("_i") > cut) & (F.col("_i") <= F.col("_n") - cut)).groupBy(*by).agg(F.avg(value).alias("trimmed"))


def stratified(rows: DataFrame, key: str, n: int, *by: str) -> DataFrame:
    """n rows of each stratum in the order of a sha256 of the key: a sample that any engine repeats."""
    w = Window.partitionBy(*by).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; zero where undefined."""
    p, r = (F.coalesce(tp / F.nullif(tp + x, F.lit(0)), F.lit(0.0)) for x in (fp, fn))
    return p, r, F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def rates(passed: Column, skipped: Column) -> Column:
    """Share of passes among what was not skipped; null if nothing was."""
    return F.sum(F.when(~skipped, passed.cast("double"))) / F.nullif(F.count_if(~skipped), F.lit(0))


def verdict(status: Column) -> Column:
    """fail if any failed, else warn if any warned, else pass; skipped counts for nothing."""
    worst = F.max(F.when(status == "fail", 2).when(status == "warn", 1).otherwise(0))
    return F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass")


def decision(lift: Column, p_better: Column, trimmed: Column, floors_met: Column, latency_ok: Column) -> Column:
    """The reasons against a candidate, none for acceptance: lift 0.04, probability 0.95, trimmed mean above zero, floors, latency."""
    tests = [(lift < 0.04, "lift"), (p_better < 0.95, "probability"), (trimmed <= 0, "trimmed mean"), (~floors_met, "floors"), (~latency_ok, "latency")]
    return F.array_compact(F.array(*(F.when(t, F.lit(n)) for t, n in tests)))
