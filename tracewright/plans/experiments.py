"""Queries around experiments; documents, events and embeddings stand for runs, scores and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import experiments as E
from ..registry import query, table


def _list(*x: str):
    return F.array(*map(F.lit, x))


@query(
    "failure_classes",
    """WITH s AS (SELECT doc_id, doc_id % 29 = 0 AS skipped, doc_id % 5 = 0 AS passed, doc_id % 7 = 1 AS plain, doc_id % 3 <> 0 AS types, doc_id % 4 <> 1 AS sub, doc_id % 6 = 0 AS doc, doc_id % 2 = 0 AS canonical, doc_id % 11 = 0 AS edge, doc_id % 3 = 1 AS need,
  doc_id % 13 = 0 AS hard, doc_id % 8 < 4 AS probed, CASE WHEN doc_id % 8 < 3 THEN doc_id % 20 END AS rank, n_chars AS ms, doc_id % 17 = 0 AS invalid FROM documents),
c AS (SELECT *, CASE WHEN skipped THEN NULL WHEN passed THEN CASE WHEN ms > 2000 THEN 'slow-but-passing' END WHEN invalid THEN 'fixture-invalid' WHEN hard THEN 'hard-negative-violated' WHEN probed AND rank IS NULL THEN 'retrieval-miss' WHEN probed AND rank > 10 THEN 'retrieved-not-ranked'
  WHEN plain THEN 'missing-edge' WHEN NOT types OR NOT (CASE WHEN canonical THEN doc ELSE sub END) THEN 'retrieved-not-ranked' ELSE 'answer-synthesis' END AS failure_class FROM s)
SELECT doc_id, failure_class, CASE WHEN failure_class = 'missing-edge' AND need AND NOT edge THEN 'edge-extraction' WHEN failure_class IN ('missing-edge', 'answer-synthesis') THEN 'trace' WHEN failure_class = 'fixture-invalid' THEN 'fixture' WHEN failure_class = 'retrieval-miss' THEN 'embedding' ELSE 'ranking' END AS layer FROM c WHERE failure_class IS NOT NULL""",
)
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    scores = table(spark, sf_dir, "documents").select(
        "doc_id", (d % 29 == 0).alias("skipped"), (d % 5 == 0).alias("passed"), (d % 7 == 1).alias("passed_query_only"), (d % 3 != 0).alias("required_types"), (d % 4 != 1).alias("substring_found"), (d % 6 == 0).alias("document_id_found"), (d % 2 == 0).alias("canonical"),
        (d % 11 == 0).alias("edge_hop_found"), (d % 3 == 1).alias("require_edge_hop"), (d % 13 == 0).alias("hard_negative"), (d % 8 < 4).alias("probed"), F.when(d % 8 < 3, d % 20).alias("gold_rank"), F.lit(10).alias("top_k"), F.col("n_chars").alias("duration_ms"),
        F.when(d % 17 == 0, "invalid").otherwise("applicable").alias("preflight"),
    )
    return E.diagnosed(scores, 2000).select("doc_id", "failure_class", "layer")


@query(
    "regressions",
    """WITH runs AS (SELECT DISTINCT user_id % 40 AS run, user_id % 4 AS variant, user_id % 2 AS corpus, CASE WHEN user_id % 40 < 4 THEN 'old' ELSE 'new' END AS print, user_id % 40 AS logged, (user_id % 40) % 9 = 0 AS breach FROM events),
r AS (SELECT user_id % 40 AS run, event_id % 25 AS family, least(1.0, avg(value) / 40 + CASE WHEN user_id % 40 >= 36 AND user_id % 4 = 1 THEN -0.5 ELSE 0 END) AS passed FROM events GROUP BY 1, 2, CASE WHEN user_id % 40 >= 36 AND user_id % 4 = 1 THEN -0.5 ELSE 0 END),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, corpus ORDER BY logged DESC, run DESC) AS k FROM runs) WHERE k = 1),
e AS (SELECT l.variant, l.corpus, l.run AS latest, b.run FROM l JOIN runs b ON b.variant = l.variant AND b.corpus = l.corpus AND b.print = l.print AND b.run <> l.run),
p AS (SELECT e.variant, e.corpus, e.run, row_number() OVER (PARTITION BY e.variant, e.corpus, e.run ORDER BY n.family) - 1 AS pos, o.passed - n.passed AS d FROM e JOIN r n ON n.run = e.latest JOIN r o ON o.run = e.run AND o.family = n.family),
z AS (SELECT variant, corpus, run, count(*) AS n FROM p GROUP BY ALL),
dr AS (SELECT z.*, i, j, CAST(concat('0x', substr(sha256(concat_ws(':', i, j)), 1, 13)) AS BIGINT) % n AS pos FROM z, range(100) t(i), range(25) u(j) WHERE j < n),
le AS (SELECT variant, corpus, run, i, avg(d) AS lead FROM dr JOIN p USING (variant, corpus, run, pos) GROUP BY ALL),
w AS (SELECT variant, corpus, run, avg(lead) AS delta, avg(CASE WHEN lead > 0 THEN 1.0 ELSE 0.0 END) AS ahead FROM le GROUP BY ALL),
t AS (SELECT variant, corpus, count(*) AS baseline, count(*) FILTER (WHERE ahead >= 0.95 AND delta >= 0.04) AS wins FROM w GROUP BY ALL)
SELECT l.variant, l.corpus, l.run AS latest, coalesce(baseline, 0) AS baseline, coalesce(wins, 0) AS wins, CASE WHEN coalesce(baseline, 0) < 3 THEN 'insufficient-history' WHEN breach AND wins >= baseline // 2 + 1 THEN 'both' WHEN breach THEN 'breach' WHEN wins >= baseline // 2 + 1 THEN 'regression' ELSE 'ok' END AS status
FROM l LEFT JOIN t ON t.variant = l.variant AND t.corpus = l.corpus""",
)
def regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    events = table(spark, sf_dir, "events")
    runs = events.select((u % 40).alias("run"), (u % 4).alias("variant"), (u % 2).alias("corpus"), F.when(u % 40 < 4, "old").otherwise("new").alias("fingerprint"), (u % 40).alias("logged_at"), (u % 40 % 9 == 0).alias("breach")).distinct()
    shift = F.when((F.col("run") >= 36) & (F.col("run") % 4 == 1), -0.5).otherwise(0.0)
    results = events.groupBy((u % 40).alias("run"), (F.col("event_id") % 25).alias("family")).agg(F.avg("value").alias("v")).select("run", "family", F.least(F.lit(1.0), F.col("v") / 40 + shift).alias("passed"))
    return E.regressions(runs, results, 100)


@query(
    "candidate_labels",
    """WITH c AS (SELECT doc_id, (['trace', 'causal', 'lookup', 'howto'])[doc_id % 4 + 1] AS kind, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 31 + 1 END AS rank, doc_id % 3 = 0 AS traced, doc_id % 7 AS hops, doc_id % 6 <> 0 AS covered, doc_id % 41 = 0 AS person FROM documents),
f AS (SELECT *, concat_ws(',', CASE WHEN kind IN ('trace', 'causal') AND hops = 0 THEN 'unsupported-schema' END, CASE WHEN NOT covered THEN 'retrieval-failure' END) AS fixes FROM c),
l AS (SELECT *, CASE WHEN rank IS NULL AND NOT traced THEN 'auto-reject' WHEN rank < 4 THEN 'trivial-suspect' WHEN rank IS NULL THEN 'human-review' WHEN fixes <> '' THEN 'needs-fix' WHEN rank <= 20 THEN 'keeper-candidate' ELSE 'human-review' END AS label FROM f)
SELECT doc_id, label, CASE WHEN label = 'auto-reject' THEN 'unsupported-data' ELSE concat_ws(',', nullif(fixes, ''), CASE WHEN label = 'trivial-suspect' THEN 'trivial-low-signal' WHEN label = 'human-review' THEN 'retrieval-failure' END) END AS reasons, person OR label IN ('keeper-candidate', 'human-review') AS kept FROM l""",
)
def candidate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.get(_list("trace", "causal", "lookup", "howto"), (d % 4).cast("int"))
    label = E.candidate_label(kind, F.when(d % 5 != 0, d % 31 + 1), d % 3 == 0, d % 7, d % 6 != 0)
    rows = table(spark, sf_dir, "documents").select("doc_id", label.alias("x"))
    return rows.select("doc_id", "x.label", F.array_join("x.reasons", ",").alias("reasons"), E.keeps(F.col("x.label"), d % 41 == 0, include_review=True).alias("kept"))


@query(
    "display_categories",
    """WITH q AS (SELECT doc_id, (['lookup', 'trace', 'compare', 'temporal', 'causal', 'howto', 'entity-resolution'])[doc_id % 7 + 1] AS kind, doc_id % 10 = 0 AS hard, doc_id % 3 AS h FROM documents)
SELECT doc_id, CASE WHEN hard THEN 'hard-negative' WHEN kind = 'lookup' AND h = 0 THEN 'file-level' WHEN kind = 'trace' AND h = 1 THEN 'work-lineage' WHEN kind = 'lookup' THEN 'direct-lookup' WHEN kind = 'howto' THEN 'synthesis' WHEN kind = 'entity-resolution' THEN 'coverage' ELSE 'cross-source' END AS category FROM q""",
)
def display_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.get(_list("lookup", "trace", "compare", "temporal", "causal", "howto", "entity-resolution"), (d % 7).cast("int"))
    hints = F.when(d % 3 == 0, _list("chunking")).when(d % 3 == 1, _list("edge-extraction", "trace")).otherwise(_list("edge-extraction"))
    return table(spark, sf_dir, "documents").select("doc_id", E.display_category(kind, d % 10 == 0, hints).alias("category"))


@query(
    "template_strata",
    """WITH s AS (SELECT DISTINCT lang, source, n_chars < 1000 AS short FROM documents), t AS (SELECT * FROM (VALUES ('any', NULL, NULL, NULL), ('english', 'en', NULL, NULL), ('short src1', NULL, 'src1', 'rare'), ('two', 'fr', NULL, 'common'), ('two', 'de', 'src2', NULL)) v(template, a, b, c))
SELECT DISTINCT concat_ws('/', lang, source, CASE WHEN short THEN 'rare' ELSE 'common' END) AS stratum, template FROM s JOIN t ON (a IS NULL OR a = lang) AND (b IS NULL OR b = source) AND (c IS NULL OR c = CASE WHEN short THEN 'rare' ELSE 'common' END)""",
)
def template_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rarity = F.when(F.col("n_chars") < 1000, "rare").otherwise("common")
    strata = table(spark, sf_dir, "documents").select(F.col("lang").alias("source_type"), F.col("source").alias("edge_type"), rarity.alias("rarity")).distinct()
    strata = strata.withColumn("stratum", F.concat_ws("/", "source_type", "edge_type", "rarity"))
    templates = spark.createDataFrame(
        [("any", []), ("english", [("en", None, None)]), ("short src1", [(None, "src1", "rare")]), ("two", [("fr", None, "common"), ("de", "src2", None)])],
        "template string, patterns array<struct<source_type:string,edge_type:string,rarity:string>>",
    )
    return E.applicable(strata, templates)


@query(
    "patch_checks",
    """WITH p AS (SELECT doc_id, text, doc_id % 9 = 0 AS none, doc_id % 5 = 0 AS short, doc_id % 4 AS k FROM documents),
o AS (SELECT *, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN 'same' ELSE text END AS old, CASE WHEN k = 2 THEN 'same' ELSE concat('a', chr(10), doc_id) END AS new, CASE WHEN doc_id % 3 = 0 THEN 'docs/x.md' ELSE concat('packages/search/src/', lang_of) END AS file FROM (SELECT p.*, lang AS lang_of FROM p JOIN documents USING (doc_id))),
s AS (SELECT *, CASE WHEN none OR k IN (1, 2) THEN 0 ELSE 2 + length(old) - length(replace(old, chr(10), '')) + 1 END AS lines FROM o)
SELECT doc_id, CASE WHEN none THEN 'empty' ELSE concat_ws(',', CASE WHEN short THEN 'base' END, CASE WHEN k = 1 THEN 'anchor' WHEN k = 2 THEN 'no-op' END, CASE WHEN k NOT IN (1, 2) AND doc_id % 3 = 0 THEN 'path' END, CASE WHEN lines > 3 THEN 'size' END) END AS problems, CAST(lines AS INTEGER) AS lines FROM s""",
)
def patch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text as the passage that a patch replaces."""
    d = F.col("doc_id")
    k = d % 4
    edit = F.struct(F.when(d % 3 == 0, "docs/x.md").otherwise(F.concat(F.lit("packages/search/src/"), "lang")).alias("file"), F.when(k == 1, "").when(k == 2, "same").otherwise(F.col("text")).alias("old"), F.when(k == 2, "same").otherwise(F.concat(F.lit("a\n"), d)).alias("new"))
    edits = F.when(d % 9 == 0, F.array().cast("array<struct<file:string,old:string,new:string>>")).otherwise(F.array(edit))
    patches = table(spark, sf_dir, "documents").select("doc_id", F.when(d % 5 == 0, "abc").otherwise("0123456789").alias("base_sha"), edits.alias("edits"))
    return E.patch_problems(patches, most=3).select("doc_id", F.array_join("problems", ",").alias("problems"), "lines")


@query(
    "knob_checks",
    """WITH p AS (SELECT p_partkey, (['autoRoute', 'reranker', 'topK', 'traceMinScore', 'nothing'])[p_partkey % 5 + 1] AS name, (['boolean', 'number', 'string'])[p_partkey % 3 + 1] AS kind, CASE p_partkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'bge' WHEN 2 THEN '12' WHEN 3 THEN '0.4' WHEN 4 THEN '31' WHEN 5 THEN '7.5' ELSE 'off' END AS value FROM part),
n AS (SELECT *, TRY_CAST(value AS DOUBLE) AS x FROM p)
SELECT p_partkey, name, CASE WHEN name = 'nothing' THEN 'unknown' WHEN name = 'autoRoute' THEN CASE WHEN kind <> 'boolean' THEN 'type' END WHEN name = 'topK' THEN CASE WHEN kind <> 'number' OR x IS NULL OR x <> floor(x) THEN 'type' WHEN x NOT BETWEEN 5 AND 30 THEN 'range' END
  WHEN name = 'traceMinScore' THEN CASE WHEN kind <> 'number' OR x IS NULL THEN 'type' WHEN x NOT BETWEEN 0.1 AND 0.6 THEN 'range' END ELSE CASE WHEN kind <> 'string' THEN 'type' WHEN value NOT IN ('off', 'llm:haiku', 'bge') THEN 'option' END END AS problem FROM n""",
)
def knob_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    pick = lambda n, *x: F.get(_list(*x), (p % n).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", pick(5, "autoRoute", "reranker", "topK", "traceMinScore", "nothing").alias("name"), pick(3, "boolean", "number", "string").alias("kind"), pick(7, "true", "bge", "12", "0.4", "31", "7.5", "off").alias("value"))
    return E.knob_problem(rows).select("p_partkey", "name", "problem")


@query(
    "config_fingerprints",
    """SELECT doc_id, sha256(concat('{"config":{"a":{"lang":"', lang, '","z":[', doc_id, ',true,null]},"source":"', source, '"},"v":1}')) AS fingerprint FROM documents""",
)
def config_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings written with keys in two orders have one fingerprint."""
    inner = F.concat(F.lit('{"z": ['), "doc_id", F.lit(', true,null] , "lang":"'), "lang", F.lit('"}'))
    one = F.concat(F.lit('{"source":"'), "source", F.lit('","a":'), inner, F.lit("}"))
    two = F.concat(F.lit('{ "a" :'), inner, F.lit(', "source": "'), "source", F.lit('"}'))
    return table(spark, sf_dir, "documents").select("doc_id", E.fingerprint(F.when(F.col("doc_id") % 2 == 0, one).otherwise(two)).alias("fingerprint"))


@query(
    "model_answers",
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN concat('[{"t":', doc_id, '}]') WHEN 1 THEN concat('[', doc_id, ',2]') WHEN 2 THEN concat('[{"t":', doc_id, '}]') WHEN 3 THEN concat('[', doc_id, ']') WHEN 4 THEN concat('{"a":1,"b":', doc_id, '}') END AS json FROM documents""",
)
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are plain JSON, an object around an array, fenced, in prose, an object in prose, and none."""
    d = F.col("doc_id")
    say = lambda a, b: F.concat(F.lit(a), d, F.lit(b))
    answer = F.when(d % 6 == 0, say(' [{"t": ', "}] ")).when(d % 6 == 1, say('{"edges": [', ", 2]}")).when(d % 6 == 2, say('Here:\n```json\n{"edges":[{"t":', "}]}\n```\nDone.")).when(d % 6 == 3, say("The list is [", "] as asked")).when(d % 6 == 4, say('It is {"b": ', ', "a": 1} I think')).otherwise("no idea")
    return table(spark, sf_dir, "documents").select("doc_id", E.model_json(answer).alias("json"))


@query(
    "grounding_totals",
    """WITH g AS (SELECT conv_id AS query_id, CASE WHEN turn % 5 = 4 THEN NULL WHEN length(text) % 3 = 0 THEN 'supported' WHEN length(text) % 3 = 1 THEN 'partial' ELSE 'unsupported' END AS verdict FROM conversations WHERE conv_id % 9 <> 0),
q AS (SELECT query_id, count(verdict) AS claims, count(*) FILTER (WHERE verdict = 'supported') AS supported, count(*) FILTER (WHERE verdict = 'partial') AS partial, count(*) FILTER (WHERE verdict = 'unsupported') AS unsupported FROM g GROUP BY query_id)
SELECT count(*) AS queries, CAST(sum(claims) AS BIGINT) AS claims, CAST(sum(supported) AS BIGINT) AS supported, CAST(sum(partial) AS BIGINT) AS partial, CAST(sum(unsupported) AS BIGINT) AS unsupported, round(avg(CASE WHEN claims > 0 THEN unsupported / claims ELSE 0.0 END), 6) AS hallucination FROM q""",
)
def grounding_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text") % 3
    verdict = F.when(F.col("turn") % 5 != 4, F.when(n == 0, "supported").when(n == 1, "partial").otherwise("unsupported"))
    grades = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), verdict.alias("verdict"), (F.col("conv_id") % 9 == 0).alias("failed"))
    return E.grounding(grades).withColumn("hallucination", F.round("hallucination", 6))


@query(
    "storage_report",
    """WITH s AS (SELECT o_custkey % 30 AS seg, o_orderkey AS id FROM orders), g AS (SELECT seg, seg = 7 AS bad, count(*) AS n FROM s GROUP BY seg), k AS (SELECT id FROM s WHERE seg <> 7),
e AS (SELECT l_orderkey AS source_id, l_orderkey AS o FROM lineitem), c AS (SELECT o_orderkey AS c FROM orders UNION ALL SELECT -c_custkey FROM customer WHERE c_custkey % 10 = 0)
SELECT (SELECT count(*) FROM g) AS segments, (SELECT count(*) FROM g WHERE bad) AS failures, CAST((SELECT sum(n) FROM g WHERE NOT bad) AS BIGINT) AS chunks, CAST((SELECT sum(n) FROM g WHERE NOT bad) AS BIGINT) AS edges,
  (SELECT count(*) FROM e WHERE source_id NOT IN (SELECT id FROM k)) AS dangling, (SELECT count(*) FROM c WHERE c NOT IN (SELECT id FROM k)) AS orphans, 0::BIGINT AS unread, CASE WHEN (SELECT count(*) FROM g WHERE bad) > 0 THEN 'fail' ELSE 'warn' END AS verdict""",
)
def storage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.groupBy((F.col("o_custkey") % 30).alias("segment_id")).agg(F.collect_list("o_orderkey").alias("chunks"))  # a segment is one object
    segments = rows.withColumn("edges", F.when(F.col("segment_id") != 7, F.col("chunks")))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"))
    layers = spark.createDataFrame([(True,)], "read boolean")
    wrong = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.array(-F.col("c_custkey")).alias("chunk_ids"))
    return E.storage_report(segments, edges, layers, orders.select(F.array("o_orderkey").alias("chunk_ids")).unionByName(wrong))


_EDGES = """e AS (SELECT doc_id, lang AS from_type, CASE doc_id % 6 WHEN 0 THEN 'bare' WHEN 1 THEN 'concept' WHEN 2 THEN 'package' WHEN 3 THEN 'url' ELSE CASE WHEN t.lang2 IS NULL THEN 'unresolved' ELSE 'resolved' END END AS class, t.lang2 AS to_type
  FROM documents d LEFT JOIN (SELECT doc_id AS t_id, lang AS lang2 FROM documents WHERE doc_id % 4 <> 0) t ON t.t_id = d.doc_id + 1)"""


@query(
    "resolution_report",
    f"""WITH {_EDGES}, s AS (SELECT count(*) AS edges, count(*) FILTER (WHERE class = 'resolved') AS resolved, count(*) FILTER (WHERE class = 'bare') AS bare, count(*) FILTER (WHERE class = 'concept') AS concept, count(*) FILTER (WHERE class = 'package') AS package, count(*) FILTER (WHERE class = 'url') AS url,
  count(*) FILTER (WHERE class <> 'bare' AND to_type <> from_type) AS crossing FROM e)
SELECT *, round(resolved / edges, 6) AS rate, round(resolved / (edges - concept - bare), 6) AS adjusted, round(resolved / (edges - concept - bare - package - url), 6) AS in_scope, round(bare / edges, 6) AS bare_rate, round(crossing / resolved, 6) AS density, CASE WHEN resolved / edges < 0.05 THEN 'fail' WHEN resolved / edges < 0.23 THEN 'warn' ELSE 'pass' END AS verdict FROM s""",
)
def resolution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.resolution_report(_resolved_edges(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("rate", "adjusted", "in_scope", "bare_rate", "density")})


@query("resolution_by_type", f"WITH {_EDGES}, c AS (SELECT from_type, count(*) AS n, count(*) FILTER (WHERE class NOT IN ('bare', 'concept') AND to_type IS NOT NULL) AS resolved FROM e GROUP BY from_type) SELECT from_type, n, resolved, round(resolved / n, 6) AS rate FROM c")
def resolution_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.resolution_by_type(_resolved_edges(spark, sf_dir)).withColumn("rate", F.round("rate", 6))


def _resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = F.col("doc_id")
    target = docs.where("doc_id % 4 <> 0").select((d - 1).alias("doc_id"), F.col("lang").alias("to_type"))
    kind = F.get(_list("bare", "concept", "package", "url"), (d % 6).cast("int"))
    return docs.join(target, "doc_id", "left").select(F.col("lang").alias("from_type"), F.coalesce(kind, F.when(F.col("to_type").isNull(), "unresolved").otherwise("resolved")).alias("class"), "to_type")


@query("storage_documents", "SELECT l_partkey AS storage_id, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS document_id FROM lineitem GROUP BY l_partkey")
def storage_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("storage_id"), F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return E.documents_of(rows)


@query(
    "reindexed_chunks",
    """WITH d AS (SELECT doc_id, text, doc_id % 3 <> 0 AS has FROM documents), s AS (SELECT doc_id, text, length(text) <= 3000 AS short, has FROM d),
w AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 0, 1), 3000)) AS o FROM s WHERE NOT short),
p AS (SELECT CAST(doc_id AS VARCHAR) AS id, NULL AS parent_id, text, has AS preserved FROM s WHERE short
  UNION ALL SELECT sha256(concat_ws(':', doc_id, o // 3000, substr(text, o + 1, 3000))), CAST(doc_id AS VARCHAR), substr(text, o + 1, 3000), FALSE FROM w WHERE regexp_matches(substr(text, o + 1, 3000), '\\S')),
c AS (SELECT id, (i - 1) % 4 AS p, sum(unicode(c))::DOUBLE AS v FROM (SELECT id, unnest(s) AS c, unnest(range(1, len(s) + 1)) AS i FROM (SELECT id, string_split(text, '') AS s FROM p WHERE NOT preserved)) GROUP BY ALL),
f AS (SELECT k.id, k.p, coalesce(c.v, 0) AS v FROM (SELECT DISTINCT id, t.p FROM c, range(4) t(p)) k LEFT JOIN c ON c.id = k.id AND c.p = k.p),
v AS (SELECT id, string_agg(CAST(round(1000 * v / n) AS BIGINT), ',' ORDER BY p) AS v FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY id)) AS n FROM f) GROUP BY id)
SELECT id, parent_id, length(text) AS n, preserved, CASE WHEN preserved THEN '1000' ELSE v END AS vector FROM p LEFT JOIN v USING (id)""",
)
def reindexed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are kept in thousandths and in double, so that they are rounded once."""
    from ..functions.vectors import character_sums, unit
    from ..operators import jobs

    vector = F.when(F.col("doc_id") % 3 != 0, F.array(F.lit(1000.0)))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), vector.alias("embedding"))
    out = jobs.reindexed(chunks, True, lambda c: unit(character_sums(c, 4), 1000.0), 3000)
    vector = F.array_join(F.transform("embedding", lambda x: F.round(x).cast("long").cast("string")), ",")
    return out.select("id", "parent_id", F.length("content").cast("long").alias("n"), "preserved", vector.alias("vector"))


@query("segmented_chunks", "WITH s AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 37 AS segment FROM documents) SELECT segment, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM s GROUP BY segment")
def segmented_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import jobs

    rows = jobs.segmented(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 37)
    return rows.groupBy("segment").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("published_refs", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'segment' ELSE 'raw-source-blob' END AS kind, concat('a', doc_id) AS id, concat('cid', doc_id) AS address, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents")
def published_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import jobs

    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("doc_id") % 2 == 0, "segment").otherwise("raw-source-blob")
    artifacts = docs.select(kind.alias("kind"), F.concat(F.lit("a"), "doc_id").alias("id"), F.col("text").cast("binary").alias("content"), F.sha2("text", 256).alias("recorded"))
    return jobs.published(artifacts, docs.select(F.concat(F.lit("a"), "doc_id").alias("id"), F.concat(F.lit("cid"), "doc_id").alias("address")))


@query(
    "reingested_chunks",
    """WITH b AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS document_id, CASE WHEN conv_id % 2 = 0 THEN concat('u', conv_id) ELSE 'f' END AS ts, CASE WHEN conv_id % 2 = 0 THEN 'updated' ELSE 'ingested' END AS timestamp_kind, CASE WHEN conv_id % 4 < 2 THEN 'own' ELSE 'old' END AS author FROM b""",
)
def reingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived conversations cut anew: one row for each document that gave chunks, with its date and completed metadata."""
    from ..operators import jobs

    c = F.col("conv_id")
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("content"))
    updated = F.when(c % 2 == 0, F.concat(F.lit("u"), c)).otherwise("")
    own = F.create_map(F.lit("author"), F.lit("own"), F.lit("updated"), updated)
    archive = texts.select(c.cast("string").alias("document_id"), F.lit("v1").alias("version"), F.lit("a.md").alias("path"), F.lit("github-issue").alias("source_type"), F.when(c % 4 < 2, own).alias("metadata"), F.lit("f").alias("fetched"), "content")
    old = texts.select(c.cast("string").alias("document_id"), F.lit(0).alias("ord"), F.create_map(F.lit("author"), F.lit("old"), F.lit("updated"), updated).alias("metadata"))
    out = jobs.reingested(archive, old)
    return out.select("document_id", "ts", "timestamp_kind", F.element_at("metadata", "author").alias("author")).distinct()


@query(
    "planned_samples",
    """WITH RECURSIVE s AS (SELECT lang AS source_type, source AS query_type, count(*) AS artifacts FROM documents WHERE lang <> 'es' GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY artifacts DESC, source_type, query_type) AS k FROM s),
c AS (SELECT lang AS source_type, doc_id AS artifact, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM documents WHERE lang <> 'de'), n AS (SELECT source_type, count(*) AS n FROM c GROUP BY source_type),
p AS (SELECT o.source_type, o.query_type, o.artifacts, n.n, row_number() OVER (ORDER BY o.k) AS k FROM o JOIN n ON n.source_type = o.source_type),
g AS (SELECT 1 AS k, CAST((1 * 9301 + 49297) % 233280 AS BIGINT) AS x UNION ALL SELECT k + 1, (x * 9301 + 49297) % 233280 FROM g WHERE k < 200),
d AS (SELECT p.source_type, p.query_type, p.k, CAST(floor(g.x / 233280 * p.n) AS BIGINT) % p.n AS place FROM p JOIN g ON g.k = p.k),
t AS (SELECT d.*, c.artifact FROM d JOIN c ON c.source_type = d.source_type AND c.place = d.place WHERE d.query_type NOT IN ('src1', 'src2'))
SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS place, source_type, query_type, artifact FROM t QUALIFY row_number() OVER (ORDER BY k) <= 15""",
)
def planned_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    from ..operators import jobs

    docs = table(spark, sf_dir, "documents")
    strata = docs.where("lang <> 'es'").groupBy(F.col("lang").alias("source_type"), F.col("source").alias("query_type")).agg(F.count("*").alias("artifacts")).withColumn("ord", F.struct("source_type", "query_type"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1
    candidates = docs.where("lang <> 'de'").select(F.col("lang").alias("source_type"), place.cast("long").alias("place"), F.col("doc_id").alias("artifact"))
    templates = strata.where("query_type NOT IN ('src1', 'src2')").select("source_type", "query_type", F.lit("t").alias("template"))
    return jobs.planned(strata, candidates, templates, 5).drop("template")
