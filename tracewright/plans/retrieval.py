"""Queries over ``embeddings`` and ``documents``: label or language stands for the source type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import character_sums, dot, norm, unit
from ..operators import retrieval as R
from ..registry import query, table

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_LANGS = "CASE d.lang WHEN 'en' THEN 1.2 WHEN 'fr' THEN 0.7 ELSE 1.0 END"
BOOSTS = {"en": 1.2, "fr": 0.7}


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("t"), "label").alias("source_type"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("source_type"), "source", "n_chars")
    return vectors.join(docs, "id")


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector whose id is divisible by 50, against all rows."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _thousandths(vector: Column) -> Column:
    """A vector's direction in thousandths, comma-joined; rounded from doubles, as a unit vector stored as float can lie on the other side of a half."""
    return F.array_join(F.transform(unit(vector, 1000.0), lambda x: F.round(x).cast("long").cast("string")), ",")


_SCORED = f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s)"""


@query("vector_topk", f"{_SCORED} SELECT query_id, id, round(score, 6) AS score, r AS rank FROM f WHERE r <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(_queries(spark, sf_dir), _chunks(spark, sf_dir), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vector_topk_batch", f"{_SCORED} SELECT query_id, id, round(score, 6) AS score, r AS rank FROM f WHERE r <= 100")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(_queries(spark, sf_dir), _chunks(spark, sf_dir), 100).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_FETCHED = f"""
WITH a AS (SELECT q.vec_id AS query_id, e.vec_id AS id, d.lang, d.source, {_COS} AS retrieval FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, embeddings q WHERE q.vec_id % 50 = 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval DESC, id) AS fetched FROM a) WHERE fetched <= 100)"""


@query("query_filtered", f"""{_FETCHED} SELECT query_id, id, lang AS source_type, round(retrieval, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY retrieval DESC, id) AS rank FROM f
  WHERE lang IN ('en', 'de') AND lang NOT IN ('de') AND retrieval >= 0.05) WHERE rank <= 10""")
def query_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.search(_queries(spark, sf_dir), _documents(spark, sf_dir), 10, include=["en", "de"], exclude=["de"], min_score=0.05)
    return out.select("query_id", "id", "source_type", F.round("retrieval", 6).alias("score"), "rank")


@query("query_boosted", f"""{_FETCHED} SELECT query_id, id, lang AS source_type, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT *, retrieval * {_LANGS} AS score FROM f d)) WHERE rank <= 10""")
def query_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.search(_queries(spark, sf_dir), _documents(spark, sf_dir), 10, type_boosts=BOOSTS, min_score=-1.0)
    return out.select("query_id", "id", "source_type", F.round("score", 6).alias("score"), "rank")


@query(
    "query_diverse",
    f"""{_FETCHED}, s AS (SELECT query_id, id, lang, retrieval, retrieval * CASE lang WHEN 'en' THEN 1.2 WHEN 'fr' THEN 0.7 ELSE 1.0 END AS score FROM f),
m AS (SELECT *, max(retrieval) OVER (PARTITION BY query_id) AS top, row_number() OVER (PARTITION BY query_id, lang ORDER BY score DESC, id) AS t, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS p FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (t = 1 AND retrieval >= 0.65 * top) DESC, score DESC, id) AS slot FROM m)
SELECT query_id, id, lang AS source_type, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, p > 10 AS promoted FROM k WHERE slot <= 10""",
)
def query_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.search(_queries(spark, sf_dir), _documents(spark, sf_dir), 10, type_boosts=BOOSTS, diverse=True, min_score=-1.0)
    return out.select("query_id", "id", "source_type", F.round("score", 6).alias("score"), "rank", "promoted")


@query("query_diagnostics", f"{_FETCHED} SELECT query_id, lang AS source_type, count(*) AS candidates, CAST(count(*) FILTER (WHERE fetched <= 10) AS BIGINT) AS returned FROM f GROUP BY ALL")
def query_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.top_k(_queries(spark, sf_dir), _documents(spark, sf_dir), 100)
    return out.groupBy("query_id", "source_type").agg(F.count("*").alias("candidates"), F.count_if(F.col("rank") <= 10).alias("returned"))


@query("rerank_passthrough", f"{_SCORED} SELECT query_id, id, CAST(20 - r + 1 AS DOUBLE) AS rerank FROM f WHERE r <= 20")
def rerank_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.passthrough_rerank(R.top_k(_queries(spark, sf_dir), _chunks(spark, sf_dir), 20)).select("query_id", "id", "rerank")


@query(
    "seed_selection",
    f"""{_SCORED}, b AS (SELECT query_id, id, score * CASE WHEN label = 3 THEN 1.5 ELSE 1.0 END AS boosted FROM f WHERE r <= 25)
SELECT query_id, id, round(boosted, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, id) AS k FROM b WHERE boosted >= 0.1) WHERE k <= 5""",
)
def seed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace seeds: five times the candidates when there are boosts, floor 0.1 here."""
    near = R.top_k(_queries(spark, sf_dir), _chunks(spark, sf_dir), 25)
    boosted = near.withColumn("boosted", R.composite(F.col("score"), None, {"t3": 1.5}, F.col("source_type"))).drop("rank").where("boosted >= 0.1")
    return R.ranked(boosted, 5, "boosted").select("query_id", "id", F.round("boosted", 6).alias("score"))


@query(
    "fallback_fill",
    f"""{_SCORED}, t AS (SELECT query_id, id, label, score, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, id) AS k, max(score) OVER (PARTITION BY query_id, label) AS best FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, label, k) AS n FROM t WHERE k <= 3)
SELECT query_id, id, label, round(score, 6) AS score, n AS place FROM o WHERE n <= 15""",
)
def fallback_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 3 for each type and 15 in all, types in order of their best."""
    chunks = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    out = R.filled(R.top_k(_queries(spark, sf_dir), chunks, 3, by="label"), "label", 15)
    return out.select("query_id", "id", "label", F.round("score", 6).alias("score"), "place")


@query(
    "vector_math",
    """SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm,
  round(list_dot_product(embedding::DOUBLE[], list_transform(range(1, len(embedding) + 1), lambda i: CAST(i AS DOUBLE))), 4) AS slope FROM embeddings""",
)
def vector_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    slope = dot(e, F.transform(F.sequence(F.lit(1), F.size(e)), lambda i: i.cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(norm(e), 5).alias("norm"), F.round(slope, 4).alias("slope"))


@query(
    "cluster_exemplars",
    """WITH u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY label, i),
cl AS (SELECT label, list(m ORDER BY i) AS centre FROM c GROUP BY label),
s AS (SELECT e.label, e.vec_id AS id, list_cosine_similarity(e.embedding::DOUBLE[], cl.centre) AS score FROM embeddings e JOIN cl USING (label))
SELECT label, id, round(score, 5) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS r FROM s) WHERE r <= 3""",
)
def cluster_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 3 by similarity to the centroid of each label; centroids are averaged dimension by dimension, map-side first."""
    from ..functions.vectors import cosine

    rows = table(spark, sf_dir, "embeddings")
    size = rows.select(F.max(F.size("embedding"))).first()[0] or 0
    means = rows.groupBy("label").agg(*(F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(size)))
    centres = means.select("label", F.array(*(f"m{i}" for i in range(size))).alias("centre"))
    scored = rows.join(centres, "label").select("label", F.col("vec_id").alias("id"), cosine(F.col("embedding"), F.col("centre")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.col("score").desc(), "id"))
    return scored.withColumn("rank", rank).where("rank <= 3").select("label", "id", F.round("score", 5).alias("score"), "rank")


@query(
    "hash_embedder",
    """WITH c AS (SELECT page_id, (i - 1) % 8 AS p, unicode(c)::DOUBLE AS v FROM (SELECT page_id, unnest(s) AS c, unnest(range(1, len(s) + 1)) AS i FROM (SELECT page_id, string_split(concat(url, html), '') AS s FROM pages))),
b AS (SELECT page_id, p, sum(v) AS v FROM c GROUP BY ALL), n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY page_id)) AS n FROM b)
SELECT page_id, string_agg(CAST(round(1000 * v / n) AS BIGINT), ',' ORDER BY p) AS embedding FROM n GROUP BY page_id""",
)
def hash_embedder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deterministic embedder over whole pages, their address first."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", _thousandths(character_sums(F.concat("url", F.coalesce("html", F.lit(""))), 8)).alias("embedding"))


@query("unit_vectors", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(round(1000 * x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS BIGINT)), ',') AS unit FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors in thousandths."""
    return table(spark, sf_dir, "embeddings").select("vec_id", _thousandths(F.col("embedding")).alias("unit"))


@query(
    "greedy_clusters",
    """WITH RECURSIVE p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3),
l AS MATERIALIZED (SELECT a, list(b) AS bs FROM p GROUP BY a), o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
s AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS head, []::BIGINT[] AS got UNION ALL
  SELECT i, done, id, CASE WHEN list_contains(done, id) THEN [] ELSE list_filter(bs, lambda b: NOT list_contains(done, b)) END FROM (SELECT o.i, o.id, list_concat(s.taken, s.got) AS done, coalesce(l.bs, []) AS bs FROM s JOIN o ON o.i = s.i + 1 LEFT JOIN l ON l.a = o.id) x),
c AS (SELECT head, got, row_number() OVER (ORDER BY head) - 1 AS cluster FROM s WHERE len(got) > 0),
m AS (SELECT head AS id, cluster FROM c UNION ALL SELECT unnest(got), cluster FROM c)
SELECT e.vec_id AS id, m.cluster FROM embeddings e LEFT JOIN m ON m.id = e.vec_id""",
)
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.cluster import greedy

    return greedy(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.3)


@query(
    "similar_pairs",
    "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3",
)
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.cluster import similar_pairs as pairs

    return pairs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), 0.3).withColumn("score", F.round("score", 5))


@query(
    "indexed_topk",
    """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS e, label FROM embeddings WHERE vec_id % 11 <> 0),
s AS (SELECT q.vec_id AS query_id, v.id, v.label, list_cosine_similarity(v.e, q.embedding::DOUBLE[]) AS score FROM v, embeddings q WHERE q.vec_id % 50 = 0)
SELECT query_id, id, label, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM s) WHERE r <= 10""",
)
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of two thirds of the vectors, the rest upserted, one in seven turned round, one in eleven deleted, then compacted and changed once more."""
    import uuid

    from ..operators.index import VectorIndex
    from ..session import shared_folder

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    turned = rows.where("id % 7 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    index = VectorIndex.create(rows.where("id % 3 <> 0"), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.upsert(rows.where("id % 3 = 0"))
    index.upsert(turned.where("id % 2 = 0"))
    index.delete(rows.where("id % 11 = 0"))
    index.compact()
    index.upsert(turned.where("id % 2 = 1 AND id % 11 <> 0"))
    return index.search(_queries(spark, sf_dir), 10).select("query_id", "id", "label", F.round("score", 6).alias("score"), "rank")
