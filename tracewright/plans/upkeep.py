"""Queries around replay, logs and authored queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import statistics
from ..operators import trace as T
from ..operators import upkeep as U
from ..registry import query, table
from .trace import _HOPS, _hops


@query("donor_scan", "SELECT lang AS collection, count(*) AS n FROM documents WHERE source = 'src3' AND lang <> 'en' AND doc_id % 5 <> 0 GROUP BY lang")
def donor_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("collection"), F.col("source").alias("source_key"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id").cast("string")).alias("storage_id"))
    return U.donors(rows, F.lit("en"), F.lit("src3"))


@query("replay_timestamps", """WITH k AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'ingested' ELSE (['updated', 'updated', 'updated', 'updated', 'created', 'created', 'committed', 'committed', 'published', 'ingested', 'ingested'])[doc_id % 11 + 1] END AS kind FROM documents)
SELECT doc_id, CASE WHEN kind = 'ingested' THEN 'f' ELSE concat(kind[1], doc_id) END AS ts, kind FROM k""")
def replay_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kinds = "github-issue github-pr github-pr-comment github-discussion slack-message discord-message code markdown doc-page hn-story other".split()
    kind = F.get(F.array(*map(F.lit, kinds)), (d % len(kinds)).cast("int"))
    every = F.create_map(*(x for k in ("updated", "created", "committed", "published") for x in (F.lit(k), F.concat(F.lit(k[0]), d))))
    meta = F.when(d % 5 == 0, F.create_map(F.lit("updated"), F.lit(""), F.lit("created"), F.lit(""))).otherwise(every)  # an empty entry counts for nothing
    return table(spark, sf_dir, "documents").select("doc_id", U.replay_timestamp(kind, meta, F.lit("f")).alias("x")).select("doc_id", "x.ts", "x.kind")


@query("metadata_backfill", """SELECT o_custkey AS document_id, CASE WHEN o_custkey % 4 = 0 THEN 'own' ELSE (SELECT o2.o_orderpriority FROM orders o2 WHERE o2.o_custkey = o.o_custkey AND o2.o_orderstatus = 'F' ORDER BY o2.o_orderkey LIMIT 1) END AS author FROM (SELECT DISTINCT o_custkey FROM orders) o""")
def metadata_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    meta = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("author"), "o_orderpriority", F.lit("repo"), F.lit("r"))).otherwise(F.create_map(F.lit("repo"), F.lit("r")))
    chunks = o.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("ord"), meta.alias("metadata"))
    archive = o.select(F.col("o_custkey").alias("document_id")).distinct().withColumn("metadata", F.when(F.col("document_id") % 4 == 0, F.create_map(F.lit("author"), F.lit("own"))))
    return U.backfilled(archive, chunks).select("document_id", F.try_element_at("metadata", F.lit("author")).alias("author"))


@query(
    "token_batches",
    """WITH RECURSIVE c AS (SELECT source AS context, doc_id AS id, CAST(ceil(length(text) / 4.0) AS BIGINT) + 15 AS need, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
b AS (SELECT context, id, i, need AS used, 0 AS batch FROM c WHERE i = 1 UNION ALL
  SELECT c.context, c.id, c.i, CASE WHEN b.used + c.need > 4000 THEN c.need ELSE b.used + c.need END, b.batch + CASE WHEN b.used + c.need > 4000 THEN 1 ELSE 0 END FROM b JOIN c ON c.context = b.context AND c.i = b.i + 1)
SELECT context, id, CAST(batch AS INTEGER) AS batch FROM b""",
)
def token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("context"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    return U.token_batches(rows, 4000).select("context", "id", "batch")


@query("silence_window", "WITH i AS (SELECT DISTINCT o_custkey % 200 AS incident, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT DISTINCT o_custkey % 200 AS incident, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'O') SELECT incident, count(*) AS n FROM i WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.incident = i.incident AND f.d <= i.d AND i.d - f.d < 30) GROUP BY incident")
def silence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("incident"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    return U.silenced(o.where("o_orderstatus = 'F'").select("incident", "day").distinct(), o.where("o_orderstatus = 'O'").select("incident", "day").distinct(), 30).groupBy("incident").agg(F.count("*").alias("n"))


@query("embedding_cache", "SELECT CASE WHEN sha256(concat('m', chr(10), text)) IN (SELECT sha256(concat('m', chr(10), text)) FROM documents WHERE doc_id % 2 = 0) THEN 'hit' ELSE 'miss' END AS outcome, count(*) AS n FROM documents GROUP BY 1")
def embedding_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    cache = docs.where("id % 2 = 0").select(F.sha2(F.concat_ws("\n", F.lit("m"), "content"), 256).alias("key"), F.lit(1).alias("vector")).distinct()
    hits, misses = U.cached(docs, cache, "m")
    return hits.select(F.lit("hit").alias("outcome")).unionAll(misses.select(F.lit("miss"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("ignore_filter", "SELECT doc_id, (doc_id % 4 = 0 AND doc_id % 8 <> 0) OR doc_id % 4 = 1 AS skipped FROM documents")
def ignore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    path = F.when(d % 8 == 0, F.concat(F.lit("src/keep/"), d, F.lit(".log"))).when(d % 4 == 0, F.concat(F.lit("src/a/"), d, F.lit(".log"))).when(d % 4 == 1, F.concat(F.lit("x/dist/"), d)).otherwise(F.concat(F.lit("src/"), d, F.lit(".py")))
    return table(spark, sf_dir, "documents").select("doc_id", U.ignored(path, ["# built", "*.log", "dist/", "!src/keep/*.log", ""]).alias("skipped"))


@query("config_precedence", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'cli' WHEN c_custkey % 3 = 0 THEN 'env' WHEN c_custkey % 2 = 0 THEN 'file' ELSE 'default' END AS value FROM customer")
def config_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", U.setting(F.when(k % 5 == 0, F.lit("cli")), F.when(k % 3 == 0, F.lit("env")), F.when(k % 2 == 0, F.lit("file")), F.lit("default")).alias("value"))


@query("excerpts", "SELECT conv_id, sha256(substr(string_agg(text, chr(10) ORDER BY turn), 1, 4000)) AS digest FROM conversations GROUP BY conv_id")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ord"), F.col("text").alias("content"))
    return U.excerpts(rows).select(F.col("document_id").alias("conv_id"), F.sha2("excerpt", 256).alias("digest"))


@query("authored_queries", """WITH q AS (SELECT *, doc_id % 97 AS k FROM documents), s AS (SELECT doc_id, text, k, CASE WHEN k = 0 THEN '' WHEN k < 4 THEN concat('x', k) ELSE concat('q', doc_id // 2) END AS id, CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE text END AS query FROM q),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc_id) AS r FROM s)
SELECT doc_id, length(query) AS n_chars, concat_ws(',', CASE WHEN id = '' THEN 'missing id' END, CASE WHEN id IN ('x1', 'x3') THEN 'known id' END, CASE WHEN id <> '' AND r > 1 THEN 'duplicate id' END, CASE WHEN query IS NULL OR trim(query) = '' THEN 'empty query' END, CASE WHEN doc_id % 5 = 0 THEN 'empty corpora' END,
  CASE WHEN doc_id % 7 = 3 THEN 'query type' END, CASE WHEN doc_id % 4 = 3 THEN 'difficulty' END, CASE WHEN doc_id % 6 = 2 THEN 'layer hint' END, CASE WHEN doc_id % 8 = 1 THEN 'empty evidence' END, CASE WHEN doc_id % 9 = 4 THEN 'missing source types' END,
  CASE WHEN doc_id % 3 = 0 THEN 'min results' END, CASE WHEN doc_id % 10 = 7 THEN 'missing collection' END, CASE WHEN doc_id % 6 = 5 THEN 'empty layer hints' END) AS problems FROM n""")
def authored_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a query that somebody wrote, with faults in each field by rule."""
    d, none = F.col("doc_id"), F.array().cast("array<string>")
    listed = lambda *x: F.array(*map(F.lit, x))
    k = d % 97
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", d.alias("ord"), F.when(k == 0, "").when(k < 4, F.concat(F.lit("x"), k)).otherwise(F.concat(F.lit("q"), F.floor(d / 2))).alias("id"), F.when(d % 13 == 0, "  ").otherwise(F.col("text")).alias("query"),
        F.when(d % 5 == 0, none).otherwise(listed("v1")).alias("corpora"), F.when(d % 7 == 3, "guess").otherwise("lookup").alias("query_type"), F.get(listed("easy", "medium", "hard", "odd"), (d % 4).cast("int")).alias("difficulty"),
        F.when(d % 6 == 2, listed("ranking", "luck")).when(d % 6 == 5, none).otherwise(listed("trace")).alias("layer_hints"), F.when(d % 8 == 1, none).otherwise(listed("a")).alias("evidence"), F.when(d % 9 != 4, none).alias("source_types"),
        (d % 3).cast("int").alias("min_results"), F.when(d % 10 == 7, " ").otherwise("c1").alias("collection"),
    )
    known = spark.createDataFrame([("x1",), ("x3",), ("x9",)], "id string")
    return U.authored_problems(rows, known).select("doc_id", F.length("query").cast("long").alias("n_chars"), F.array_join("problems", ",").alias("problems"))


@query(
    "gold_matching",
    r"""WITH RECURSIVE g AS (SELECT doc_id // 20 AS chunk, doc_id AS g, doc_id % 3 AS how, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS i FROM documents WHERE doc_id % 2 = 0),
p AS (SELECT doc_id // 20 AS chunk, list(doc_id ORDER BY doc_id) AS free FROM documents GROUP BY 1),
s AS (SELECT p.chunk, 0::BIGINT AS i, p.free, NULL::BIGINT AS g, NULL::BIGINT AS p FROM p UNION ALL
  SELECT chunk, i, list_filter(free, lambda x: x <> coalesce(p, -1)), g, p FROM (SELECT s.chunk, g.i, s.free, g.g, CASE WHEN g.how = 0 THEN list_filter(s.free, lambda x: x = g.g)[1] ELSE s.free[1] END AS p FROM s JOIN g ON g.chunk = s.chunk AND g.i = s.i + 1))
SELECT chunk, g, p FROM s WHERE p IS NOT NULL""",
)
def gold_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    of = F.floor(d / 20)  # a chunk has the edges of twenty documents
    predicted = docs.select(of.alias("chunk"), d.alias("p"), F.lit("references").alias("type"), F.concat(F.lit("Acme/Repo#"), d).alias("target"))
    how = F.when(d % 3 == 0, "exact").when(d % 3 == 1, "substring").otherwise("regex")
    gold = docs.where("doc_id % 2 = 0").select(of.alias("chunk"), d.alias("g"), F.lit("references").alias("type"), F.when(how == "exact", F.concat(F.lit("Acme/Repo#"), d)).when(how == "substring", F.lit("acme/repo")).otherwise(F.lit(r"#\d+$")).alias("target"), how.alias("how"))
    return U.greedy_matches(predicted, gold)


@query(
    "evidence_chains",
    f"""WITH RECURSIVE {_HOPS}, p(query_id, leaf, above, kinds) AS (
  SELECT query_id, hop_index, parent_hop_index, [source_type] FROM h WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.query_id = h.query_id AND c.parent_hop_index = h.hop_index)
  UNION ALL SELECT p.query_id, p.leaf, u.parent_hop_index, list_concat([u.source_type], p.kinds) FROM p JOIN h u ON u.query_id = p.query_id AND u.hop_index = p.above),
l AS (SELECT query_id, leaf, array_to_string(list_transform(list_filter(range(1, len(kinds) + 1), lambda i: i = 1 OR kinds[i] <> kinds[i - 1]), lambda i: kinds[i]), '>') AS types, len(list_distinct(kinds)) AS variety FROM p WHERE above < 0),
d AS (SELECT query_id, types, max(variety) AS variety, min(leaf) AS leaf FROM l WHERE variety >= 3 GROUP BY query_id, types),
k AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM d o WHERE o.query_id = d.query_id AND starts_with(o.types, concat(d.types, '>'))))
SELECT query_id, types, CAST(variety AS INTEGER) AS variety, round(least(0.5 + 0.15 * variety, 1.0), 4)::DOUBLE AS strength FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY variety DESC, leaf) AS r FROM k) WHERE r <= 3""",
)
def evidence_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.evidence_chains(T.lineage(_hops(spark, sf_dir))).select("query_id", F.col("label").alias("types"), "variety", F.round("strength", 4).alias("strength"))


@query("flipped_queries", "SELECT doc_id, CASE WHEN quality = 1 THEN 'pass to fail' ELSE 'fail to pass' END AS flip FROM labels WHERE doc_id % 7 = 0")
def flipped_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose outcome differs between two runs."""
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("before"))
    b = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("after"))
    return a.join(b, "doc_id").where("before <> after").select("doc_id", F.when(F.col("before") == 1, "pass to fail").otherwise("fail to pass").alias("flip"))


@query("signal_coverage", """WITH s AS (SELECT lang, doc_id % 3 = 0 AS a, doc_id % 5 = 0 AS b FROM documents) SELECT lang, count(*) AS n, CAST(count(*) FILTER (WHERE a) AS BIGINT) AS pain, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS praise, round(100.0 * count(*) FILTER (WHERE a OR b) / count(*), 4)::DOUBLE AS covered FROM s GROUP BY lang""")
def signal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    scores = F.map_filter(F.create_map(F.lit("pain"), F.when(d % 3 == 0, 20), F.lit("praise"), F.when(d % 5 == 0, 40)), lambda _, v: v.isNotNull())
    rows = table(spark, sf_dir, "documents").select("lang", scores.alias("m"))
    has = lambda k: F.count_if(F.map_contains_key("m", k))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), has("pain").alias("pain"), has("praise").alias("praise"), F.round(100.0 * F.count_if(F.size("m") > 0) / F.count("*"), 4).alias("covered"))


@query("source_suggestions", r"""WITH m AS (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) SELECT host, count(*) AS n FROM m WHERE host NOT LIKE 'www.%' GROUP BY host ORDER BY n DESC, host LIMIT 10""")
def source_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten hosts that are mentioned most and not ingested."""
    hosts = table(spark, sf_dir, "pages").select(F.try_parse_url("url", F.lit("HOST")).alias("host"))
    known = hosts.where("host LIKE 'www.%'").distinct()
    return hosts.join(known, "host", "left_anti").groupBy("host").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "host").limit(10)


@query("latency_calibration", "SELECT user_id % 4 AS variant, round(max(value) FILTER (WHERE event_type = 'view'), 4) AS view_max, round(quantile_cont(value, 0.95) FILTER (WHERE event_type = 'click'), 6) AS click_p95, count(*) AS n FROM events GROUP BY 1")
def latency_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("variant"), "event_type", "value")
    rows = events.groupBy("variant").agg(F.round(F.max(F.when(F.col("event_type") == "view", F.col("value"))), 4).alias("view_max"), F.count("*").alias("n"))
    p95 = statistics.percentiles(events.where("event_type = 'click'"), "value", {"click_p95": 0.95}, "variant")
    return rows.join(p95, "variant", "left").select("variant", "view_max", F.round("click_p95", 6).alias("click_p95"), "n")


@query("next_knob", "WITH k AS (SELECT p_partkey AS knob, p_size AS phase, p_retailprice AS probe FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)) SELECT knob, phase, probe FROM k ORDER BY phase, knob LIMIT 1")
def next_knob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first untried setting in order of phase."""
    tried = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_partkey").alias("knob"))
    knobs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("knob"), F.col("p_size").alias("phase"), F.col("p_retailprice").alias("probe"))
    return knobs.join(tried, "knob", "left_anti").orderBy("phase", "knob").limit(1)


@query("layer_union", "SELECT layer, count(*) AS n FROM (SELECT 'a' AS layer FROM orders UNION ALL SELECT 'b' FROM lineitem UNION ALL SELECT 'a' FROM customer) GROUP BY layer")
def layer_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(x).alias("layer")) for t, x in (("orders", "a"), ("lineitem", "b"), ("customer", "a"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("layer").agg(F.count("*").alias("n"))


@query("shared_corpora", "SELECT DISTINCT lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT DISTINCT lang FROM documents WHERE doc_id % 3 = 0 AND source = 'src1'")
def shared_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.where("doc_id % 2 = 0").select("lang").intersect(docs.where("doc_id % 3 = 0 AND source = 'src1'").select("lang"))


@query("query_type_deltas", "SELECT lang, round(avg(toxic) - avg(quality), 6) AS delta FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def query_type_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.round(F.avg("toxic") - F.avg("quality"), 6).alias("delta"))


@query("headline_score", "SELECT round(sqrt(avg(quality) * avg(1 - toxic)), 6) AS headline FROM labels")
def headline_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").agg(F.round(F.sqrt(F.avg("quality") * F.avg(1 - F.col("toxic"))), 6).alias("headline"))


@query("integrity_report", "SELECT source, count(*) AS n, CAST(count(*) FILTER (WHERE length(text) = n_chars) AS BIGINT) AS right_size, count(DISTINCT sha256(text)) AS distinct_texts FROM documents GROUP BY source")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", (F.length("text") == F.col("n_chars")).alias("ok"), F.sha2("text", 256).alias("h"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("ok").alias("right_size"), F.countDistinct("h").alias("distinct_texts"))


@query("theme_evaluation", "WITH c AS (SELECT label, count(*) AS n, count(DISTINCT vec_id % 4) AS kinds FROM embeddings GROUP BY label) SELECT min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean, round(avg(kinds), 4) AS mean_kinds FROM c")
def theme_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct(F.col("vec_id") % 4).alias("kinds"))
    return c.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 4).alias("mean"), F.round(F.avg("kinds"), 4).alias("mean_kinds"))


@query("gold_rank_probe", "WITH s AS (SELECT q.vec_id AS q, e.vec_id AS id, e.label, q.label AS ql, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) SELECT q AS query_id, min(r) FILTER (WHERE label <> ql AND r <= 50) AS rank FROM s GROUP BY q")
def gold_rank_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the top 50 with another label."""
    from ..operators import retrieval as R

    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    top = R.top_k(queries, rows.select(F.col("vec_id").alias("id"), "embedding", "label"), 50).join(rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return top.groupBy("query_id").agg(F.min(F.when(F.col("label") != F.col("own"), F.col("rank"))).cast("long").alias("rank"))


@query("dotted_paths", """WITH RECURSIVE t AS (SELECT l_orderkey AS doc, l_linenumber AS i, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber // 2 END AS parent, concat('s', l_linenumber) AS name FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
p AS (SELECT doc, i, name AS path FROM t WHERE parent = 0 UNION ALL SELECT t.doc, t.i, concat(p.path, '.', t.name) FROM t JOIN p ON p.doc = t.doc AND p.i = t.parent) SELECT doc, i, path FROM p""")
def dotted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names of each document's symbol tree; a symbol whose ancestors are not all there has none."""
    i = F.col("l_linenumber")
    symbols = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), i.alias("i"), F.when(i == 1, 0).otherwise(F.floor(i / 2)).cast("int").alias("parent"), F.concat(F.lit("s"), i).alias("name")).distinct()
    return T.dotted(symbols)


@query("run_log_rows", "SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type = 'error' AND value > 20) > 0 THEN NULL ELSE round(sum(value), 4) END AS cost, round(max(value), 4) AS latency FROM events GROUP BY user_id")
def run_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("user_id")
    return rows.agg(F.when(F.count_if((F.col("event_type") == "error") & (F.col("value") > 20)) == 0, F.round(F.sum("value"), 4)).alias("cost"), F.round(F.max("value"), 4).alias("latency"))


@query("adversarial_filter", "WITH s AS (SELECT q.vec_id AS q, e.vec_id AS id, e.label, q.label AS ql, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS r FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id) SELECT q AS query_id FROM s GROUP BY q HAVING count(*) FILTER (WHERE r <= 3 AND label = ql) = 0")
def adversarial_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that no required artifact answers within the top three."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    from ..operators import retrieval as R

    top = R.top_k(queries, rows.select(F.col("vec_id").alias("id"), "embedding", "label"), 4).where("id <> query_id")
    w = Window.partitionBy("query_id").orderBy("rank")
    near = top.withColumn("k", F.row_number().over(w)).where("k <= 3").join(rows.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").where("label = own")
    return queries.select("query_id").join(near, "query_id", "left_anti")
