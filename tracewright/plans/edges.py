"""Edge queries: orders and line items are edges, documents carry derived references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as E
from ..registry import ORACLE_SQL, query, table

#: References, the same on both sides, and the whole text behind them.
CONTENT = (
    "concat(CASE WHEN doc_id % 3 = 0 THEN concat('fixes acme/repo', CAST(doc_id % 7 AS VARCHAR(9)), '#', CAST(doc_id AS VARCHAR(9))) ELSE concat('closes #', CAST(doc_id % 11 AS VARCHAR(9))) END,"
    " ' see https://github.com/acme/repo', CAST(doc_id % 5 AS VARCHAR(9)), '/issues/', CAST(doc_id % 50 AS VARCHAR(9)), ' and #', CAST(doc_id % 13 AS VARCHAR(9)),"
    " ' or PROJ-', CAST(doc_id % 20 AS VARCHAR(9)), ' UTF-8 [guide](https://docs.example.com/p', CAST(doc_id % 9 AS VARCHAR(9)), ')"
    " https://team.slack.com/archives/C0', CAST(doc_id % 4 AS VARCHAR(9)), '/p17000', CAST(doc_id AS VARCHAR(9)), ' ', coalesce(text, ''))"
)
_SOURCE = "concat('acme/repo', CAST(doc_id % 6 AS VARCHAR(9)), '#', CAST(doc_id AS VARCHAR(9)))"


def derived_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 4 == 0, "github-issue").otherwise("slack-message")
    return docs.select(F.col("doc_id").alias("id"), F.expr(CONTENT).alias("content"), kind.alias("source_type"), F.expr(_SOURCE).alias("source"))


_CHUNKS = f"c AS (SELECT doc_id AS id, {CONTENT} AS content, CASE WHEN doc_id % 4 = 0 THEN 'github-issue' ELSE 'slack-message' END AS source_type, {_SOURCE} AS source FROM documents)"
_R = "[a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+"


@query(
    "regex_edges",
    rf"""WITH {_CHUNKS},
m AS (SELECT id, content, CASE WHEN source_type = 'github-issue' THEN split_part(source, '#', 1) END AS explicit,
  list_concat(regexp_extract_all(content, 'https?://github\.com/({_R})/(?:issues|pull)/(\d+)', 1), regexp_extract_all(content, '({_R})#(\d+)', 1)) AS repos FROM c),
u AS (SELECT id, unnest(list_concat(CASE WHEN explicit IS NULL THEN [] ELSE [explicit] END, repos)) AS repo, unnest(range(1, 9)) AS i FROM m),
b AS (SELECT repo FROM u WHERE repo IS NOT NULL GROUP BY repo ORDER BY count(*) DESC, min(id * 100 + i) LIMIT 1),
r AS (SELECT id, content, explicit IS NOT NULL AS sure, coalesce(explicit, repos[1], (SELECT repo FROM b)) AS repo FROM m),
cl AS (SELECT id, repo, sure, content, regexp_extract_all(content, '(?i)\b(?:closes|close|closed|fix|fixes|fixed|resolve|resolves|resolved)\s+(?:{_R}#\d+|#\d+)') AS ms FROM r),
closes AS (SELECT id, 'closes' AS type, CASE WHEN ev LIKE '%/%' THEN regexp_extract(ev, '{_R}#\d+') ELSE concat(repo, '#', regexp_extract(ev, '#(\d+)', 1)) END AS target_id, ev AS evidence,
  CASE WHEN ev LIKE '%/%' OR sure THEN 1.0 ELSE 0.5 END AS confidence FROM (SELECT *, unnest(ms) AS ev FROM cl)),
refs AS (
  SELECT id, unnest(regexp_extract_all(content, '{_R}#\d+')) AS target_id, unnest(regexp_extract_all(content, '{_R}#\d+')) AS evidence, 1.0 AS confidence FROM r
  UNION ALL SELECT id, concat(repo, '#', n) AS target_id, concat('#', n) AS evidence, CASE WHEN sure THEN 1.0 ELSE 0.5 END FROM (
    SELECT id, repo, sure, unnest(regexp_extract_all(regexp_replace(content, '{_R}#\d+', ' ', 'g'), '#(\d+)', 1)) AS n FROM r)),
urls AS (SELECT id, regexp_replace(u, '^https?://github\.com/({_R})/(?:issues|pull)/(\d+)$', '\1#\2') AS target_id, u AS evidence FROM (SELECT id, unnest(regexp_extract_all(content, 'https?://github\.com/{_R}/(?:issues|pull)/\d+')) AS u FROM c))
SELECT id AS source_id, type, target_id, evidence, CAST(confidence AS DOUBLE) AS confidence FROM closes
UNION ALL SELECT id, 'references', target_id, evidence, CAST(confidence AS DOUBLE) FROM refs WHERE NOT EXISTS (SELECT 1 FROM closes k WHERE k.id = refs.id AND k.target_id = refs.target_id)
UNION ALL SELECT id, 'references', target_id, evidence, 1.0::DOUBLE FROM urls""",
)
def regex_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.regex_edges(derived_chunks(spark, sf_dir)).select("source_id", "type", "target_id", "evidence", "confidence")


@query(
    "heuristic_edges",
    rf"""WITH {_CHUNKS}
SELECT id AS source_id, 'slack-message' AS target_type, regexp_replace(u, '^https?://([a-zA-Z0-9-]+)\.slack\.com/archives/([A-Z0-9]+)/p(\d+)$', '\1/\2/p\3') AS target_id, 0.85::DOUBLE AS confidence
FROM (SELECT id, unnest(regexp_extract_all(content, 'https?://[a-zA-Z0-9-]+\.slack\.com/archives/[A-Z0-9]+/p\d+')) AS u FROM c)
UNION ALL SELECT DISTINCT id, 'jira-ticket', k, 0.85::DOUBLE FROM (SELECT id, unnest(regexp_extract_all(content, '\b[A-Z][A-Z0-9]{{1,9}}-\d+\b')) AS k FROM c) WHERE k <> 'UTF-8'
UNION ALL SELECT DISTINCT id, 'url', l, 0.8::DOUBLE FROM (SELECT id, unnest(regexp_extract_all(content, '\[[^\]]+\]\((https?://[^)]+)\)', 1)) AS l FROM c) WHERE l NOT LIKE '%github.com%'""",
)
def heuristic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.heuristic_edges(derived_chunks(spark, sf_dir)).select("source_id", "target_type", "target_id", "confidence")


@query(
    "composite_edges",
    f"""WITH r AS ({ORACLE_SQL["regex_edges"]}), h AS ({ORACLE_SQL["heuristic_edges"]}),
e AS (SELECT type, source_id, 'issue' AS target_type, target_id, confidence, 'regex' AS x FROM r UNION ALL SELECT 'references', source_id, target_type, target_id, confidence, 'heuristic' FROM h)
SELECT type, source_id, target_type, target_id, round(least(1.0, max(confidence) + 0.05 * (count(DISTINCT x) - 1)), 4)::DOUBLE AS confidence, string_agg(DISTINCT x, ',' ORDER BY x DESC) AS provenance FROM e GROUP BY type, source_id, target_type, target_id""",
)
def composite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = derived_chunks(spark, sf_dir)
    parts = [E.regex_edges(chunks).withColumn("extractor", F.lit("regex")), E.heuristic_edges(chunks).withColumn("extractor", F.lit("heuristic"))]
    parts = [p.withColumn("seq", F.struct(F.col("source_id").alias("ord"), F.lit(i).alias("extractor"), F.col("seq").alias("place"))) for i, p in enumerate(parts)]
    out = E.composite_edges(parts, table(spark, sf_dir, "documents").count())
    return out.select("type", "source_id", "target_type", "target_id", F.round("confidence", 4).alias("confidence"), F.array_join("provenance", ",").alias("provenance"))


def _line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractors over the same line items: parts by one, returned parts again by another."""
    rows = table(spark, sf_dir, "lineitem")
    one = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_partkey").cast("string").alias("target_id"), F.col("l_returnflag").alias("evidence"), (F.lit(0.5) + F.col("l_discount")).alias("confidence"), F.lit("lines").alias("extractor"))
    two = rows.where("l_returnflag = 'R'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber") + 100_000_000).alias("seq"), F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_partkey").cast("string").alias("target_id"), F.col("l_linestatus").alias("evidence"), F.lit(0.6).alias("confidence"), F.lit("returns").alias("extractor"))
    return one.unionByName(two).withColumn("type", F.lit("references")).withColumn("target_type", F.lit("part"))


_LINES = """e AS (
  SELECT l_orderkey * 10 + l_linenumber AS seq, CAST(l_orderkey AS VARCHAR) AS source_id, CAST(l_partkey AS VARCHAR) AS target_id, l_returnflag AS evidence, 0.5 + l_discount AS confidence, 'lines' AS extractor FROM lineitem
  UNION ALL SELECT l_orderkey * 10 + l_linenumber + 100000000, CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), l_linestatus, 0.6, 'returns' FROM lineitem WHERE l_returnflag = 'R')"""


@query(
    "edge_merge",
    f"""WITH {_LINES}, g AS (SELECT source_id, target_id, max(confidence) AS c, count(DISTINCT extractor) AS x FROM e GROUP BY ALL),
t AS (SELECT source_id, target_id, evidence, min(seq) AS s FROM e GROUP BY ALL)
SELECT source_id, target_id, round(least(1.0, c + 0.05 * (x - 1)), 4) AS confidence, x AS extractors, string_agg(evidence, ' | ' ORDER BY s, evidence) AS evidence
FROM g JOIN t USING (source_id, target_id) GROUP BY source_id, target_id, c, x""",
)
def edge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.merged(_line_edges(spark, sf_dir))
    return out.select("source_id", "target_id", F.round("confidence", 4).alias("confidence"), F.size("provenance").cast("long").alias("extractors"), "evidence")


@query(
    "overlay_merge",
    f"""WITH {_LINES} SELECT source_id, target_id, extractor, evidence, place FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY seq DESC) AS r, min(seq) OVER (PARTITION BY source_id, target_id) AS place FROM e) WHERE r = 1""",
)
def overlay_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.last_wins(_line_edges(spark, sf_dir)).select("source_id", "target_id", "extractor", "evidence", "place")


@query(
    "layer_compaction",
    f"""WITH {_LINES} SELECT source_id, target_id, round(confidence, 4) AS confidence, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY confidence DESC, seq) AS r FROM e
  WHERE source_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P')) WHERE r = 1""",
)
def layer_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("id"))
    return E.compacted(_line_edges(spark, sf_dir), known).select("source_id", "target_id", F.round("confidence", 4).alias("confidence"), "seq")


@query(
    "edge_bidirectional",
    """WITH e AS (SELECT o_orderkey AS s, o_custkey AS t, o_orderstatus AS ev FROM orders)
SELECT node, direction, count(*) AS n, min(evidence) AS first_evidence FROM (
  SELECT concat('o', s) AS node, 'forward' AS direction, ev AS evidence FROM e UNION ALL SELECT concat('c', t), 'reverse', concat('← ', ev) FROM e) GROUP BY ALL""",
)
def edge_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("source_id"), F.concat(F.lit("c"), "o_custkey").alias("target_id"), F.lit("placed-by").alias("type"), F.col("o_orderstatus").alias("evidence"), F.lit(1.0).alias("confidence"))
    return E.bidirectional(edges).groupBy("node", "direction").agg(F.count("*").alias("n"), F.min("evidence").alias("first_evidence"))


_TARGETS = """t AS (SELECT DISTINCT target FROM (SELECT CASE o_orderkey % 8
  WHEN 0 THEN CAST(o_custkey AS VARCHAR(20)) WHEN 1 THEN concat('https://github.com/Acme/', lower(o_orderpriority), '-', CAST(o_custkey % 40 AS VARCHAR(20)), '.git')
  WHEN 2 THEN concat('seg/', CAST(o_custkey % 9 AS VARCHAR(20))) WHEN 3 THEN concat('x/y/cust/', CAST(o_custkey % 30 AS VARCHAR(20))) WHEN 4 THEN concat('node', CAST(o_custkey % 50 AS VARCHAR(20)))
  WHEN 5 THEN concat('other-owner/node', CAST(o_custkey % 50 AS VARCHAR(20))) WHEN 6 THEN concat('GitHub.com/ACME/2-High-', CAST(o_custkey % 70 AS VARCHAR(20)))
  ELSE concat('missing-', CAST(o_custkey % 17 AS VARCHAR(20))) END AS target FROM orders))"""
_CUST_SOURCE = "CASE c_custkey % 3 WHEN 0 THEN concat('acme/2-high-', CAST(c_custkey % 60 AS VARCHAR(20))) WHEN 1 THEN concat('org/node', CAST(c_custkey % 45 AS VARCHAR(20))) ELSE concat('seg/', CAST(c_custkey % 9 AS VARCHAR(20)), '/cust/', CAST(c_custkey % 30 AS VARCHAR(20))) END"


@query(
    "edge_resolution",
    rf"""WITH {_TARGETS}, c AS (SELECT c_custkey AS id, {_CUST_SOURCE} AS norm FROM customer),
n AS (SELECT target, regexp_replace(CASE WHEN regexp_matches(target, '(?i)^(https?://)?github\.com/') THEN regexp_replace(lower(regexp_replace(target, '^(https?://)?github\.com/', '', 'i')), '\.git$', '') ELSE lower(target) END, '^\./', '') AS p FROM t),
one AS (SELECT target, 1 AS tier, id FROM t JOIN c ON CAST(c.id AS VARCHAR) = target),
two AS (SELECT target, 2 AS tier, id FROM n JOIN c ON c.norm = n.p),
rest AS (SELECT * FROM n WHERE target NOT IN (SELECT target FROM one) AND target NOT IN (SELECT target FROM two)),
probes AS (SELECT target, p AS probe, 3 AS tier FROM rest WHERE target LIKE '%/%' OR target LIKE '%:%'
  UNION ALL SELECT target, array_to_string(list_slice(string_split(p, '/'), 3, 1000), '/'), 4 FROM rest WHERE target LIKE '%/%' AND len(string_split(p, '/')) > 2),
s AS (SELECT norm, min(id) AS first, count(*) AS n FROM c GROUP BY norm),
i AS (SELECT target, tier, s.norm, coalesce(sum(n) OVER (PARTITION BY target, tier ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM probes JOIN s ON contains(s.norm, probe)),
three AS (SELECT target, tier, id FROM i JOIN c USING (norm) WHERE before < 10),
four AS (SELECT target, 5 AS tier, id FROM rest JOIN c ON strpos(rest.p, '/') > 0 AND strpos(c.norm, '/') > 0 AND substr(c.norm, strpos(c.norm, '/') + 1) = substr(rest.p, strpos(rest.p, '/') + 1)),
a AS (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four)
SELECT target, tier, count(*) AS n, min(id) AS first_id FROM a WHERE tier = (SELECT min(tier) FROM a b WHERE b.target = a.target) GROUP BY target, tier""",
)
def edge_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    targets = spark.sql(f"WITH {_TARGETS.replace('FROM orders', 'FROM _orders')} SELECT target FROM t")
    chunks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), F.expr(_CUST_SOURCE).alias("source"))
    return E.resolved(targets, chunks).groupBy("target", "tier").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(
    "edge_resolution_stats",
    rf"""WITH {_CHUNKS}, e AS (
  SELECT id, 'issue' AS target_type, concat('acme/repo', id % 7, '#', id) AS target_id FROM c UNION ALL SELECT id, 'issue', concat('#', id % 5) FROM c WHERE id % 3 = 0
  UNION ALL SELECT id, CASE id % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'package' ELSE 'url' END, concat('t', id) FROM c WHERE id % 2 = 0)
SELECT class, count(*) AS n, CAST(count(DISTINCT split_part(target_id, '#', 1)) AS BIGINT) AS repos FROM (SELECT *, CASE WHEN regexp_matches(target_id, '^#\d+$') THEN 'bare' WHEN target_type IN ('concept', 'package', 'url') THEN target_type
  WHEN target_id IN (SELECT source FROM c) THEN 'resolved' ELSE 'unresolved' END AS class FROM e) GROUP BY class""",
)
def edge_resolution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived_chunks(spark, sf_dir)
    issue = c.select("id", F.lit("issue").alias("target_type"), F.expr("concat('acme/repo', id % 7, '#', id)").alias("target_id"))
    bare = c.where("id % 3 = 0").select("id", F.lit("issue"), F.expr("concat('#', id % 5)"))
    other = c.where("id % 2 = 0").select("id", F.expr("CASE id % 3 WHEN 0 THEN 'concept' WHEN 1 THEN 'package' ELSE 'url' END"), F.expr("concat('t', id)"))
    known = c.select(F.col("source").alias("target_id"), F.lit(True).alias("hit")).distinct()
    edges = issue.union(bare).union(other).join(known, "target_id", "left").withColumn("class", E.edge_class(F.coalesce("hit", F.lit(False))))
    return edges.groupBy("class").agg(F.count("*").alias("n"), F.countDistinct(F.substring_index("target_id", "#", 1)).alias("repos"))


_RAW = """r AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'fixes' WHEN 1 THEN 'closes' WHEN 2 THEN 'implements' WHEN 3 THEN 'changes' WHEN 4 THEN 'mentions' WHEN 5 THEN 'tests' WHEN 6 THEN 'unheard' WHEN 7 THEN 'requires' ELSE 'documents' END AS raw,
  CASE doc_id % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'issue' WHEN 2 THEN 'concept' WHEN 3 THEN 'person' ELSE 'pr' END AS target_type,
  CASE doc_id % 7 WHEN 0 THEN 'TODO later' WHEN 1 THEN './src/a.ts' WHEN 2 THEN 'acme/repo#7' WHEN 3 THEN 'retry' WHEN 4 THEN 'ab' WHEN 5 THEN 'deploy-plan' ELSE 'src/b.ts' END AS target_id,
  CASE doc_id % 8 WHEN 0 THEN 'this fixes the retry loop for good' WHEN 1 THEN 'we should add it soon' WHEN 2 THEN 'related to the deploy plan' WHEN 3 THEN 'maybe it closes and fixes this' WHEN 4 THEN 'short' WHEN 5 THEN 'implements and tests the deploy plan'
    WHEN 6 THEN 'the merge is pending on review' ELSE 'changed and updated the handler file' END AS evidence, (doc_id % 10) / 10.0 AS confidence FROM documents)"""


@query(
    "edge_validation",
    rf"""WITH {_RAW}, k AS (SELECT *, CASE WHEN raw IN ('closes', 'implements', 'changes', 'tests', 'documents') THEN raw WHEN raw = 'fixes' THEN 'addresses' WHEN raw = 'requires' THEN 'depends-on' ELSE 'discusses' END AS kind FROM r),
d AS (SELECT *, (kind IN ('addresses', 'implements', 'changes', 'closes', 'tests') AND regexp_matches(evidence, '(?i)^related to'))
  OR (kind = 'addresses' AND target_type = 'person') OR (kind = 'changes' AND target_type IN ('pr', 'person', 'concept')) OR (kind = 'implements' AND target_type = 'person') OR (kind = 'closes' AND target_type IN ('person', 'concept'))
  OR (kind = 'addresses' AND NOT regexp_matches(evidence, '(?i)\bfix|\bhandl')) OR (kind = 'changes' AND NOT regexp_matches(evidence, '(?i)\bchang|\bupdat')) OR (kind = 'implements' AND NOT regexp_matches(evidence, '(?i)\bimplement|\badd\b'))
  OR (kind = 'closes' AND NOT regexp_matches(evidence, '(?i)\bcloses\b|\bfixes\b')) OR (kind = 'tests' AND NOT regexp_matches(evidence, '(?i)\btest')) OR (kind = 'discusses' AND regexp_matches(evidence, '(?i)\bmerge\b|\bpending\b')) AS down FROM k),
t AS (SELECT *, CASE WHEN down THEN 'references' ELSE kind END AS type FROM d),
g AS (SELECT *, CASE WHEN target_id LIKE 'TODO%' THEN 'placeholder' WHEN type IN ('documents', 'tests', 'implements', 'changes', 'closes') AND regexp_matches(evidence, '(?i)\bshould\b') THEN 'proposal'
  WHEN length(target_id) < 3 THEN 'short id' WHEN target_type = 'file' AND target_id LIKE './%' THEN 'relative path'
  WHEN target_type IN ('file', 'issue', 'pr') AND NOT regexp_matches(target_id, '[/.]|\d') THEN 'not resolvable' WHEN length(trim(evidence)) < 10 THEN 'short evidence'
  WHEN type = 'discusses' AND confidence < 0.6 THEN 'low confidence'
  WHEN target_type = 'concept' AND NOT ((target_id = 'retry' AND evidence LIKE '%retry%') OR (target_id = 'deploy-plan' AND evidence LIKE '%deploy plan%') OR (target_id LIKE '%/%' AND FALSE)) THEN 'not grounded'
  WHEN type IN ('implements', 'changes', 'closes', 'tests') AND regexp_matches(evidence, '(?i)\bmaybe\b') THEN 'uncertain' END AS reason FROM t)
SELECT type, coalesce(reason, 'accepted') AS outcome, count(*) AS n, CAST(count(*) FILTER (WHERE down) AS BIGINT) AS downgraded FROM g GROUP BY ALL""",
)
def edge_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    raw = spark.sql(f"WITH {_RAW.replace('FROM documents', 'FROM _documents')} SELECT * FROM r").withColumn("confidence", F.col("confidence").cast("double"))
    edges = E.validated(raw.withColumn("type", E.normalized_type(F.col("raw"))))
    return edges.groupBy("type", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"), F.count_if("downgraded").alias("downgraded"))


@query("changed_files", "SELECT 'changes' AS type, l_orderkey AS source_id, 'file' AS target_type, concat('acme/r', l_suppkey % 3, ':src/f', l_partkey, '.ts@', l_linenumber) AS target_id, concat('Changed file: src/f', l_partkey, '.ts') AS evidence, 1.0::DOUBLE AS confidence FROM lineitem")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    files = rows.select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("acme/r"), F.col("l_suppkey") % 3).alias("repo"), F.concat(F.lit("src/f"), "l_partkey", F.lit(".ts")).alias("path"), F.col("l_linenumber").cast("string").alias("sha"))
    return E.changed_file_edges(files)


@query(
    "code_imports",
    """WITH d AS (SELECT doc_id AS id, doc_id % 4 AS k FROM documents), i AS (
  SELECT id, unnest(CASE k WHEN 0 THEN ['lodash', concat('./m', id), '../b', 'fs'] WHEN 1 THEN [concat('pkg.m', id), 'os'] WHEN 2 THEN ['fmt', concat('example.com/m', id)] ELSE [concat('./A', id, '.sol')] END) AS t FROM d)
SELECT id AS source_id, CASE WHEN t LIKE '.%' THEN 'file' ELSE 'package' END AS target_type, t AS target_id FROM i""",
)
def code_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files whose text is a whole document behind its imports, which alone are edges."""
    d = F.col("doc_id")
    n = d.cast("string")
    prose = F.regexp_replace(F.coalesce("text", F.lit("")), r"['\"\n]|import|require|from|use", " ")
    code = (
        F.when(d % 4 == 0, F.concat(F.lit("import _ from 'lodash';\nimport { a,\n  b } from './m"), n, F.lit("';\nexport * from '../b';\nconst fs = require('fs');\nimport 'lodash';\n// "), prose))
        .when(d % 4 == 1, F.concat(F.lit("from pkg.m"), n, F.lit(" import x\nimport os\n# "), prose))
        .when(d % 4 == 2, F.concat(F.lit('package p\nimport (\n\t"fmt"\n\tm "example.com/m'), n, F.lit('"\n)\n// '), prose))
        .otherwise(F.concat(F.lit("pragma solidity;\nimport {A} from \"./A"), n, F.lit('.sol";\n// '), prose))
    )
    path = F.concat(F.lit("src/f"), n, F.get(F.array(F.lit(".ts"), F.lit(".py"), F.lit(".go"), F.lit(".sol")), (d % 4).cast("int")))
    return E.import_edges(table(spark, sf_dir, "documents").select(d.alias("id"), path.alias("path"), code.alias("content"))).select("source_id", "target_type", "target_id")


@query("manifest_dependencies", "WITH d AS (SELECT doc_id AS id, unnest(CASE doc_id % 3 WHEN 0 THEN ['left-pad', concat('p', doc_id), 'vitest'] WHEN 1 THEN ['numpy', concat('q', doc_id), 'requests'] ELSE ['github.com/acme/x', concat('github.com/acme/m', doc_id)] END) AS target_id FROM documents) SELECT id AS source_id, 'package' AS target_type, target_id FROM d")
def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    n = d.cast("string")
    content = (
        F.when(d % 3 == 0, F.concat(F.lit('{"name":"a","dependencies":{"left-pad":"1","p'), n, F.lit('":"^2"},"devDependencies":{"vitest":"3"}}')))
        .when(d % 3 == 1, F.concat(F.lit("# needed\nnumpy==1.2\nq"), n, F.lit(">=2 ; python_version > '3'\nrequests\n")))
        .otherwise(F.concat(F.lit("module m\n\nrequire (\n\tgithub.com/acme/x v1.0.0\n\tgithub.com/acme/m"), n, F.lit(" v0.1.0 // indirect\n)\n")))
    )
    path = F.get(F.array(F.lit("a/package.json"), F.lit("requirements-dev.txt"), F.lit("go.mod")), (d % 3).cast("int"))
    return E.dependency_edges(table(spark, sf_dir, "documents").select(d.alias("id"), path.alias("path"), content.alias("content"))).select("source_id", "target_type", "target_id")


@query("import_paths", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('acme/r/src/d', doc_id, '/util') WHEN 1 THEN concat('acme/r/src/d', doc_id, '/../x') ELSE 'react' END AS path FROM documents")
def import_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    target = F.when(d % 3 == 0, "./util").when(d % 3 == 1, "../x").otherwise("react")
    return table(spark, sf_dir, "documents").select("doc_id", E.resolved_import(target, F.concat(F.lit("src/d"), d, F.lit("/f.ts")), F.lit("acme/r")).alias("path"))



def _pretended(message: str) -> str:
    """A model's stand-in: it fails on some batches, answers some without JSON, and else finds an edge or two for each chunk."""
    import json

    chunks = json.loads(message)
    first = int(chunks[0]["chunk_id"])
    if first % 5 == 0:
        raise TimeoutError("no answer")
    if first % 7 == 0:
        return "I found nothing."
    out = []
    for c in chunks:
        n = int(c["chunk_id"])
        out.append({"type": "fixes" if n % 2 else "requires", "sourceId": c["chunk_id"] if n % 3 else "elsewhere", "targetType": "issue", "targetId": f"acme/x#{n}", "evidence": f"this fixes the {len(c['text'])} characters above" if n % 4 else " ", "confidence": n % 10 / 10})
    return "Here they are:\n```json\n" + json.dumps({"edges": out}) + "\n```"


@query(
    "model_edges",
    """WITH RECURSIVE c AS (SELECT source, doc_id, length(coalesce(text, '')) AS n, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) + 15 AS need, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
b(source, k, doc_id, n, used, first) AS (SELECT source, k, doc_id, n, need, doc_id FROM c WHERE k = 1
  UNION ALL SELECT c.source, c.k, c.doc_id, c.n, CASE WHEN b.used + c.need > 2000 THEN c.need ELSE b.used + c.need END, CASE WHEN b.used + c.need > 2000 THEN c.doc_id ELSE b.first END FROM b JOIN c ON c.source = b.source AND c.k = b.k + 1),
r AS (SELECT CASE WHEN first % 5 = 0 THEN 'TimeoutError: no answer' WHEN first % 7 = 0 THEN 'no JSON' ELSE '' END AS error, *, first % 5 <> 0 AND first % 7 <> 0 AS told FROM b),
e AS (SELECT doc_id, n, CASE WHEN doc_id % 2 = 1 THEN 'addresses' ELSE 'depends-on' END AS type, least(0.8, greatest(0.3, CAST(doc_id % 10 AS DOUBLE) / 10)) AS confidence FROM r WHERE told AND doc_id % 3 <> 0 AND doc_id % 4 <> 0)
SELECT 'batch' AS kind, error AS name, count(DISTINCT (source, first)) AS n, count(*) AS chunks, 0.0::DOUBLE AS confidence FROM r GROUP BY error
UNION ALL SELECT 'edge', type, count(*), count(DISTINCT doc_id), round(sum(confidence), 6) FROM e GROUP BY type""",
)
def model_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source in batches of 2000 tokens; what became of each batch, and the edges that pass the gates."""
    from ..operators.extract import model_edges as extracted

    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("source").alias("context"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.lit("doc-page").alias("source_type"), "source", F.col("text").alias("content"))
    edges, batches = extracted(chunks, _pretended, 2000)
    told = batches.groupBy(F.coalesce("error", F.lit("")).alias("name")).agg(F.count("*").alias("n"), F.sum(F.size("ids")).cast("long").alias("chunks")).select(F.lit("batch").alias("kind"), "name", "n", "chunks", F.lit(0.0).alias("confidence"))
    kept = edges.where("reason is null").groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("chunks"), F.round(F.sum("confidence"), 6).alias("confidence"))
    return told.unionByName(kept.select(F.lit("edge").alias("kind"), "name", "n", "chunks", "confidence"))


@query("edge_cap", "SELECT l_orderkey AS source_id, l_partkey AS target_id, seq FROM (SELECT *, l_orderkey * 10 + l_linenumber AS seq, row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r <= 2 * (SELECT count(*) FROM orders)")
def edge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap on a batch's edges in all: here two for each order, in order of extraction."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    kept = E.first_rows(edges.withColumn("seq", F.struct(F.col("at").alias("ord"))), 2 * table(spark, sf_dir, "orders").count())
    return kept.select("source_id", "target_id", F.col("at").alias("seq"))
