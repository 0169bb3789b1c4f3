"""Statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import statistics as S
from ..operators.cluster import numbered
from ..registry import query, table

_ITER = 10_000


@query(
    "paired_bootstrap",
    f"""WITH p AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(quality AS DOUBLE) AS a, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE quality END AS b FROM labels),
d AS (SELECT i, j, CAST(concat('0x', substr(sha256(concat_ws(':', i, j)), 1, 13)) AS BIGINT) % (SELECT count(*) FROM labels) AS pos FROM range({_ITER}) t(i), range((SELECT count(*) FROM labels)) u(j)),
x AS (SELECT i, sum(b - a) / (SELECT count(*) FROM labels) AS delta FROM d JOIN p USING (pos) GROUP BY i)
SELECT round(avg(delta), 6) AS mean, round(list_sort(list(delta))[251], 6) AS low, round(list_sort(list(delta))[9751], 6) AS high, round(avg(CASE WHEN delta > 0 THEN 1.0 ELSE 0.0 END), 6) AS p_better FROM x""",
)
def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("a"), F.when(F.col("doc_id") % 3 == 0, 1.0).otherwise(F.col("quality")).alias("b"))
    pairs = numbered(first, "doc_id").select(F.col("number").cast("long").alias("pos"), "a", "b")
    out = S.bootstrap_summary(S.bootstrap_deltas(pairs, _ITER), _ITER)
    return out.select(*(F.round(c, 6).alias(c) for c in ("mean", "low", "high", "p_better")))


@query(
    "pareto_frontier",
    """WITH s AS (SELECT s_suppkey AS id, s_acctbal AS q, s_nationkey AS c, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_suppkey % 17 END AS l FROM supplier)
SELECT a.id, CAST((SELECT count(*) FROM s b WHERE b.q >= a.q AND b.c <= a.c AND coalesce(b.l, 1e300) <= coalesce(a.l, 1e300) AND (b.q > a.q OR b.c < a.c OR coalesce(b.l, 1e300) < coalesce(a.l, 1e300))) AS BIGINT) AS dominators FROM s a""",
)
def pareto_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("q"), F.col("s_nationkey").cast("double").alias("c"), F.when(F.col("s_suppkey") % 11 != 0, (F.col("s_suppkey") % 17).cast("double")).alias("l"))
    return S.pareto(s, "id", "q", "c", "l").select("id", "dominators")


@query(
    "quality_cost_frontier",
    """WITH o AS (SELECT o_orderkey AS id, floor(o_totalprice / 10) AS q, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_custkey * 7 % 5000 AS DOUBLE) END AS c FROM orders)
SELECT a.id, CAST(a.q AS DOUBLE) AS q, a.c FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.q >= a.q AND coalesce(b.c, 1e300) <= coalesce(a.c, 1e300) AND (b.q > a.q OR coalesce(b.c, 1e300) < coalesce(a.c, 1e300)))""",
)
def quality_cost_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.floor(F.col("o_totalprice") / 10).cast("double").alias("q"), F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_custkey") * 7 % 5000).cast("double")).alias("c"))
    return S.frontier(rows, "q", "c")


@query("gini_coverage", """WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n) AS i, count(*) OVER (PARTITION BY lang) AS k FROM c)
SELECT lang, round(sum((2 * i - k - 1) * n) / (max(k) * sum(n)), 6)::DOUBLE AS gini FROM r GROUP BY lang""")
def gini_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return S.gini(counts, "n", "lang").select("lang", F.round("gini", 6).alias("gini"))


@query("trimmed_mean", """WITH r AS (SELECT o_orderpriority AS p, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT p AS priority, round(avg(v), 4) AS trimmed FROM r WHERE i >= floor(n * 0.1) AND i < n - floor(n * 0.1) GROUP BY p""")
def trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trimmed_mean(table(spark, sf_dir, "orders"), "o_totalprice", 0.1, "o_orderpriority").select(F.col("o_orderpriority").alias("priority"), F.round("trimmed", 4).alias("trimmed"))


@query("stratified_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified(table(spark, sf_dir, "documents"), "doc_id", 5, "lang").select("doc_id", "lang")


@query("timing_percentiles", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def timing_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "value")
    total = events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    p = S.percentiles(events, "value", {"p50": 0.5, "p95": 0.95}, "event_type")
    return total.join(p, "event_type", "left").select("event_type", "n", "total", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


@query(
    "cost_rollup",
    """WITH p AS (SELECT * FROM (VALUES ('view', 0.1), ('click', 0.2), ('purchase', 1.5), ('signup', 0.7)) t(event_type, price))
SELECT user_id, count(*) AS calls, CASE WHEN count(*) FILTER (WHERE price IS NULL AND value > 20) > 0 THEN NULL ELSE round(sum(value * price), 4) END AS cost, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS models FROM events LEFT JOIN p USING (event_type) GROUP BY user_id""",
)
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's cost is unknown if a part of it that matters (over 20) has no price."""
    prices = spark.createDataFrame([("view", 0.1), ("click", 0.2), ("purchase", 1.5), ("signup", 0.7)], "event_type string, price double")
    rows = table(spark, sf_dir, "events").join(F.broadcast(prices), "event_type", "left")
    cost = F.when(F.count_if(F.col("price").isNull() & (F.col("value") > 20)) == 0, F.round(F.sum(F.col("value") * F.col("price")), 4))
    return rows.groupBy("user_id").agg(F.count("*").alias("calls"), cost.alias("cost"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("models"))


@query("variant_matrix", "SELECT concat_ws('_', lower(r_name), n_name, d) AS id FROM region, (SELECT n_name FROM nation), (VALUES ('div'), ('nodiv')) t(d) WHERE NOT (r_name = 'ASIA' AND d = 'div')")
def variant_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of three axes of a few values each: an enumeration, not a join of data."""
    axis = spark.createDataFrame([("div",), ("nodiv",)], "d string")
    names = table(spark, sf_dir, "nation").select("n_name")
    rows = table(spark, sf_dir, "region").crossJoin(F.broadcast(names)).crossJoin(F.broadcast(axis)).where("NOT (r_name = 'ASIA' AND d = 'div')")
    return rows.select(F.concat_ws("_", F.lower("r_name"), "n_name", "d").alias("id"))


@query(
    "gate_decision",
    """WITH m AS (SELECT s_nationkey AS variant, avg(s_acctbal) / 100000 AS lift, avg(CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS p, min(s_acctbal) AS t FROM supplier GROUP BY s_nationkey)
SELECT variant, concat_ws(',', CASE WHEN lift < 0.04 THEN 'lift' END, CASE WHEN p < 0.95 THEN 'probability' END, CASE WHEN t <= 0 THEN 'trimmed mean' END, CASE WHEN variant % 4 = 0 THEN 'floors' END, CASE WHEN variant % 5 = 0 THEN 'latency' END) AS reasons FROM m""",
)
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("variant")).agg((F.avg("s_acctbal") / 100000).alias("lift"), F.avg((F.col("s_acctbal") > 0).cast("double")).alias("p"), F.min("s_acctbal").alias("t"))
    v = F.col("variant")
    return m.select("variant", F.array_join(S.decision(F.col("lift"), F.col("p"), F.col("t"), v % 4 != 0, v % 5 != 0), ",").alias("reasons"))


@query("latest_run", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT a.o_custkey AS fingerprint, a.o_orderkey AS latest, CAST((SELECT count(*) FROM r b WHERE b.o_custkey = a.o_custkey AND b.k > 1) AS BIGINT) AS baseline FROM r a WHERE a.k = 1 AND (SELECT count(*) FROM r b WHERE b.o_custkey = a.o_custkey AND b.k > 1) >= 3""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each fingerprint and its baseline, where that has three runs."""
    last = F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("fingerprint")).agg(last.alias("latest"), (F.count("*") - 1).alias("baseline")).where("baseline >= 3")


@query("tried_before", "SELECT o_custkey % 100 AS axis, max(o_orderkey) FILTER (WHERE o_orderdate = m) AS run FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey % 100) AS m FROM orders) WHERE m > TIMESTAMP '1998-06-01 00:00:00' GROUP BY 1")
def tried_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each axis, only if it is newer than the horizon."""
    rows = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 100).alias("axis")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return rows.where(F.col("x.o_orderdate") > F.lit("1998-06-01 00:00:00").cast("timestamp")).select("axis", F.col("x.o_orderkey").alias("run"))
