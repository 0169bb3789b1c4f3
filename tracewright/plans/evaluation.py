"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import retrieval as R
from ..operators import statistics as S
from ..registry import query, table
from .trace import _HOPS, _hops


@query("ingest_quality", """SELECT lang AS source_type, count(*) AS n, CAST(count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS BIGINT) AS blank, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 4) AS mean,
  CAST(quantile_cont(length(text), 0.5) AS DOUBLE) AS median, CAST(count(*) FILTER (WHERE length(text) < 50) AS BIGINT) AS short, CAST(count(*) FILTER (WHERE length(text) > 10000) AS BIGINT) AS long FROM documents GROUP BY lang""")
def ingest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.col("lang").alias("source_type"))
    return V.ingest_quality(docs).withColumn("mean", F.round("mean", 4))


@query("quality_breakdown", """SELECT lang, source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS passed FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))""")
def quality_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id").withColumn("passed", F.col("quality") == 1)
    return V.pass_breakdown(rows, "lang", "source").select("lang", "source", "n", "passed")


@query("mrr_recall", """WITH s AS (SELECT q.vec_id AS qid, q.label AS ql, e.vec_id AS id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s), h AS (SELECT qid, min(rank) FILTER (WHERE label = ql AND rank <= 10) AS f FROM r GROUP BY qid)
SELECT round(avg(coalesce(1.0 / f, 0)), 6) AS mrr, round(avg(CASE WHEN f IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall_at_10 FROM h""")
def mrr_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("of"))
    top = R.top_k(queries, rows.select(F.col("vec_id").alias("id"), "embedding", "label"), 11).where("id <> query_id")
    top = R.ranked(top.drop("rank"), 10)
    expected = queries.select("query_id", "of").join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("of")), "of").where("id <> query_id").select("query_id", "id")
    first = queries.select("query_id").join(V.reciprocal_ranks(top, expected), "query_id", "left")
    return first.agg(F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall_at_10"))


@query("edge_prf1", """WITH c AS (SELECT lang AS type, CAST(sum(CASE WHEN toxic = 1 AND p = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp, CAST(sum(CASE WHEN toxic = 0 AND p = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp, CAST(sum(CASE WHEN toxic = 1 AND p = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn
  FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 1 - toxic ELSE toxic END AS p FROM labels) JOIN documents USING (doc_id) GROUP BY lang)
SELECT type, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c WHERE tp > 0""")
def edge_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").withColumn("p", F.when(F.col("doc_id") % 3 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    count = lambda t, p: F.count_if((F.col("toxic") == t) & (F.col("p") == p))
    c = rows.groupBy(F.col("lang").alias("type")).agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(1, 0).alias("fn")).where("tp > 0")
    p, r, f = S.f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("type", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


@query("lineage_coherence", f"""WITH {_HOPS} SELECT c.edge_type, count(*) AS pairs, CAST(count(*) FILTER (WHERE c.ts IS NOT NULL AND p.ts IS NOT NULL) AS BIGINT) AS dated, CAST(count(*) FILTER (WHERE c.ts >= p.ts) AS BIGINT) AS forward
FROM h c JOIN h p ON p.query_id = c.query_id AND p.hop_index = c.parent_hop_index WHERE c.parent_hop_index >= 0 GROUP BY c.edge_type""")
def lineage_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.coherence(_hops(spark, sf_dir))


@query("lineage_monotonic", f"""WITH {_HOPS}, d AS (SELECT *, lag(ts) OVER (PARTITION BY query_id ORDER BY hop_index) AS p FROM h WHERE ts IS NOT NULL) SELECT query_id, CASE WHEN count(*) >= 2 THEN coalesce(bool_and(ts >= p), TRUE) END AS monotonic FROM d GROUP BY query_id""")
def lineage_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.monotonic(_hops(spark, sf_dir))


@query("preflight_grid", """WITH q AS (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN [] ELSE [item_id % 9, item_id % 4] END AS r FROM benchmark), c AS (SELECT DISTINCT lang AS corpus FROM documents), a AS (SELECT DISTINCT lang AS corpus, doc_id % 1000 AS artifact FROM documents WHERE doc_id % 3 <> 1)
SELECT status, corpus, count(*) AS n FROM (SELECT item_id, corpus, CASE WHEN len(r) = 0 THEN 'invalid' WHEN (SELECT count(*) FROM a WHERE a.corpus = c.corpus AND a.artifact = r[1]) > 0 AND (SELECT count(*) FROM a WHERE a.corpus = c.corpus AND a.artifact = r[2]) > 0 THEN 'applicable' ELSE 'skipped' END AS status FROM q, c) GROUP BY ALL""")
def preflight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    queries = table(spark, sf_dir, "benchmark").select(i.alias("query_id"), F.when(i % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i % 9, i % 4)).alias("required"))
    docs = table(spark, sf_dir, "documents")
    catalog = docs.select(F.col("lang").alias("corpus"), (F.col("doc_id") % 1000).alias("artifact"), F.when(F.col("doc_id") % 3 != 1, "active").otherwise("archived").alias("state"))
    corpora = docs.select(F.col("lang").alias("corpus")).distinct()
    return V.preflight(queries, corpora, catalog).groupBy("status", "corpus").agg(F.count("*").alias("n"))


@query("hard_negatives", """WITH s AS (SELECT q.vec_id AS query_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)
SELECT query_id, count(*) FILTER (WHERE score >= 0.1) < 3 AND max(score) < 0.6 AS passed FROM s WHERE r <= 10 GROUP BY query_id""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    top = R.top_k(queries, rows.select(F.col("vec_id").alias("id"), "embedding"), 11).where("id <> query_id")
    return V.hard_negative_passes(R.ranked(top.drop("rank"), 10))


@query("failure_diagnosis", """WITH c AS (SELECT event_type AS class, count(*) AS n FROM events WHERE event_type <> 'signup' GROUP BY 1), o AS (SELECT unnest(['error', 'click', 'signup', 'lost']) AS class)
SELECT class, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 6)::DOUBLE AS share FROM o LEFT JOIN c USING (class)""")
def failure_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").where("event_type <> 'signup'").groupBy(F.col("event_type").alias("class")).agg(F.count("*").alias("n"))
    return V.diagnosis(counts, ["error", "click", "signup", "lost"]).withColumn("share", F.round("share", 6))


@query("verdicts", "SELECT user_id, CASE WHEN bool_or(event_type = 'error' AND value > 95) THEN 'fail' WHEN bool_or(event_type = 'error') THEN 'warn' ELSE 'pass' END AS verdict FROM events GROUP BY user_id")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when((F.col("event_type") == "error") & (F.col("value") > 95), "fail").when(F.col("event_type") == "error", "warn").otherwise("pass")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(S.verdict(status).alias("verdict"))


@query("source_listing", "SELECT lang AS source_type, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS chunks FROM documents GROUP BY lang")
def source_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("source_type")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("chunks"))


@query("activity_cube", "SELECT event_type, user_id % 5 AS team, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY CUBE (event_type, user_id % 5)")
def activity_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("team", F.col("user_id") % 5).cube("event_type", "team").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
