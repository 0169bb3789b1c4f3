"""Ingest queries: documents are chunks, parts are artifacts, suppliers are indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..registry import query, table
from ..session import shared_folder
from .text import strip_sql


@query("dedup_antijoin", """SELECT doc_id FROM documents d WHERE doc_id % 10 >= 3 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 < 3)""")
def dedup_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("fingerprint"))
    known = rows.where("id % 10 < 3")
    return I.unseen(rows, known, known).select(F.col("id").alias("doc_id"))


@query("exclude_superseded", "SELECT doc_id FROM documents WHERE NOT (doc_id % 7 = 0 OR (doc_id % 5 = 0 AND doc_id % 2 = 0))")
def exclude_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id")
    none = F.array().cast("array<string>")
    state = F.when(F.col("doc_id") % 7 == 0, "archived").otherwise("active")
    old = F.when((F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 2 == 0), F.array("id")).otherwise(none)
    catalog = docs.select(state.alias("state"), F.array("id").alias("chunk_ids"), old.alias("superseded_chunk_ids"))
    return I.excluded(docs, catalog).select("doc_id")


@query(
    "catalog_upsert",
    """WITH o AS (SELECT doc_id, concat('v', doc_id % 3) AS version FROM documents WHERE doc_id % 4 <> 0), n AS (SELECT doc_id, concat('v', doc_id % 2) AS version, doc_id % 11 = 0 AS gone, doc_id % 13 = 0 AS app FROM documents WHERE doc_id % 3 <> 0),
j AS (SELECT coalesce(o.doc_id, n.doc_id) AS id, o.version AS ov, n.version AS nv, n.gone, n.app, n.doc_id IS NULL AS absent FROM o FULL JOIN n USING (doc_id))
SELECT CAST(id AS VARCHAR) AS document_id, CASE WHEN ov IS NULL THEN nv WHEN absent OR gone OR (ov = nv AND NOT app) THEN ov ELSE nv END AS version,
  CASE WHEN ov IS NULL THEN concat('c', nv) WHEN absent OR gone OR ov = nv THEN concat('c', ov) WHEN app THEN concat('c', ov, ',c', nv) ELSE concat('c', nv) END AS chunk_ids,
  CASE WHEN ov IS NULL OR absent OR gone OR app OR ov = nv THEN '' ELSE ov END AS previous, CASE WHEN ov IS NULL OR absent OR gone OR app OR ov = nv THEN '' ELSE concat('c', ov) END AS superseded,
  CASE WHEN gone THEN 'archived' ELSE 'active' END AS state FROM j""",
)
def catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d, none = F.col("doc_id"), F.array().cast("array<string>")
    v = lambda n: F.concat(F.lit("v"), d % n)
    kind = F.when(d % 13 == 0, "append-only").otherwise("mutable-state")
    old = docs.where("doc_id % 4 <> 0").select(d.cast("string").alias("document_id"), v(3).alias("version"), F.array(F.concat(F.lit("c"), v(3))).alias("chunk_ids"), none.alias("previous"), none.alias("superseded"), F.lit("active").alias("state"), kind.alias("mutability"))
    new = docs.where("doc_id % 3 <> 0").select(d.cast("string").alias("document_id"), v(2).alias("version"), F.array(F.concat(F.lit("c"), v(2))).alias("chunk_ids"), kind.alias("mutability"), (d % 11 == 0).alias("tombstone"))
    out = I.catalog_upsert(old, new)
    return out.select("document_id", "version", *(F.array_join(c, ",").alias(c) for c in ("chunk_ids", "previous", "superseded")), "state")


@query("cursor_decision", """SELECT user_id, CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 3 = 0 THEN concat('sha', user_id) ELSE greatest(max(strftime(ts, '%Y-%m-%d')), '2024-01-15') END AS cursor FROM events GROUP BY user_id""")
def cursor_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.date_format("ts", "yyyy-MM-dd")).alias("newest"))
    u = F.col("user_id")
    return newest.select("user_id", I.cursor(u % 5 == 0, F.when(u % 3 == 0, F.concat(F.lit("sha"), u)), F.col("newest"), F.lit("2024-01-15")).alias("cursor"))


@query(
    "segment_summary",
    """SELECT o_custkey % 50 AS segment_id, min(strftime(o_orderdate, '%Y-%m-%d')) AS "from", max(strftime(o_orderdate, '%Y-%m-%d')) AS "to", string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS source_types, string_agg(DISTINCT concat('acme/r', o_orderkey % 3), ',' ORDER BY concat('acme/r', o_orderkey % 3)) AS repos, count(*) AS chunks FROM orders GROUP BY 1""",
)
def segment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select((F.col("o_custkey") % 50).alias("segment_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts_raw"), F.col("o_orderstatus").alias("source_type"), F.concat(F.lit("acme/r"), F.col("o_orderkey") % 3, F.lit("#1")).alias("source"), F.lit(None).cast("string").alias("repo"))
    out = I.segment_summary(rows)
    return out.select("segment_id", "from", "to", F.array_join("source_types", ",").alias("source_types"), F.array_join("repos", ",").alias("repos"), "chunks")


@query(
    "revision_diff",
    """WITH j AS (SELECT coalesce(o.p_partkey, n.p_partkey) AS artifact_id, o.i AS o, n.i AS n FROM (SELECT p_partkey, p_size AS i FROM part WHERE p_partkey % 7 <> 0) o FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS i FROM part WHERE p_partkey % 3 <> 0) n USING (p_partkey))
SELECT artifact_id, 'added' AS change FROM j WHERE o IS NULL OR (n IS NOT NULL AND o <> n) UNION ALL SELECT artifact_id, 'removed' FROM j WHERE n IS NULL OR (o IS NOT NULL AND o <> n) UNION ALL SELECT artifact_id, 'unchanged' FROM j WHERE o = n""",
)
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("artifact_id"), F.col("p_size").alias("identity"))
    new = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("artifact_id"), F.expr("CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END").alias("identity"))
    return I.revision_diff(old, new)


@query(
    "snapshot_delta",
    """WITH o AS (SELECT concat('f', p_partkey) AS path, p_partkey AS hash FROM part WHERE p_partkey % 4 <> 0), n AS (SELECT CASE WHEN p_partkey % 6 = 1 THEN concat('g', p_partkey) ELSE concat('f', p_partkey) END AS path, CASE WHEN p_partkey % 5 = 2 AND p_partkey % 6 <> 1 THEN -p_partkey ELSE p_partkey END AS hash FROM part WHERE p_partkey % 9 <> 0)
SELECT n.path, CASE WHEN r.path IS NOT NULL THEN 'renamed' ELSE 'added' END AS change, r.path AS from_path FROM n LEFT JOIN o r ON r.hash = n.hash AND r.path NOT IN (SELECT path FROM n) WHERE n.path NOT IN (SELECT path FROM o)
UNION ALL SELECT o.path, 'deleted', NULL FROM o WHERE o.path NOT IN (SELECT path FROM n) AND o.hash NOT IN (SELECT hash FROM n WHERE path NOT IN (SELECT path FROM o))
UNION ALL SELECT o.path, 'modified', NULL FROM o JOIN n USING (path) WHERE o.hash <> n.hash""",
)
def snapshot_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old = p.where("p_partkey % 4 <> 0").select(F.concat(F.lit("f"), "p_partkey").alias("path"), F.col("p_partkey").alias("hash"))
    new = p.where("p_partkey % 9 <> 0").select(F.expr("CASE WHEN p_partkey % 6 = 1 THEN concat('g', p_partkey) ELSE concat('f', p_partkey) END").alias("path"), F.expr("CASE WHEN p_partkey % 5 = 2 AND p_partkey % 6 <> 1 THEN -p_partkey ELSE p_partkey END").alias("hash"))
    return I.snapshot_delta(old, new)


@query("raw_archive", "SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(text) AS checksum, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE doc_id % 4 <> 0")
def raw_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("v1").alias("version"), F.col("text").alias("content"), "doc_id")
    return I.archived_once(rows.where("doc_id % 4 = 0"), rows.drop("doc_id")).select("document_id", "checksum", "bytes")


@query(
    "index_gc",
    """WITH i AS (SELECT s_name AS name, s_acctbal AS t, s_suppkey % 9 = 0 AS active FROM supplier), k AS (SELECT *, NOT active AND 8000 - t > 7000 AS idle FROM i),
r AS (SELECT *, row_number() OVER (ORDER BY active DESC, t DESC, name) AS r FROM k WHERE NOT idle) SELECT name, 'ttl' AS reason FROM k WHERE idle UNION ALL SELECT name, 'lru' FROM r WHERE NOT active AND r > 40""",
)
def index_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("last_accessed"), (F.col("s_suppkey") % 9 == 0).alias("active"))
    return I.index_gc(s, F.lit(8000.0), 7000.0, 40)


@query("extraction_contexts", """WITH w AS (SELECT source, text, sha256(text) AS h FROM documents), c AS (SELECT source AS context, sha256(concat_ws(':', count(text), sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)), sum(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT)), sum(CAST(concat('0x', substr(h, 31, 15)) AS BIGINT)), sum(CAST(concat('0x', substr(h, 46, 15)) AS BIGINT)))) AS digest FROM w GROUP BY source)
SELECT context, digest FROM c WHERE context NOT IN ('src1', 'src2')""")
def extraction_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "source", F.col("text").alias("content"))
    none = spark.createDataFrame([], "context string, digest string, state string, extractor string")
    done = I.extraction_contexts(chunks, none, "e1").where("context in ('src1', 'src2', 'src3')")
    status = done.select("context", F.when(F.col("context") == "src3", "x").otherwise(F.col("digest")).alias("digest"), F.lit("done").alias("state"), F.lit("e1").alias("extractor"))
    return I.extraction_contexts(chunks, status, "e1")


@query(
    "overlay_placement",
    """WITH e AS (SELECT l_orderkey AS s, l_partkey AS t, 0 AS n, l_linenumber AS q FROM lineitem UNION ALL SELECT l_orderkey + 5, l_partkey, 1, l_linenumber FROM lineitem WHERE l_returnflag = 'R'),
l AS (SELECT *, row_number() OVER (PARTITION BY s, t ORDER BY n DESC, q DESC) AS r FROM e)
SELECT o_custkey % 20 AS segment_id, count(*) AS n, CAST(sum(l.n) AS BIGINT) AS overlays FROM l LEFT JOIN orders ON o_orderkey = s AND o_orderstatus <> 'P' WHERE r = 1 GROUP BY 1""",
)
def overlay_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    shape = lambda s, r: r.select(F.lit("references").alias("type"), s.alias("source_id"), F.lit("part").alias("target_type"), F.col("l_partkey").alias("target_id"), F.col("l_linenumber").alias("seq"))
    chunks = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("segment_id"))
    out = I.placed_overlays(shape(F.col("l_orderkey") + 5, rows.where("l_returnflag = 'R'")), shape(F.col("l_orderkey"), rows), chunks)
    return out.groupBy("segment_id").agg(F.count("*").alias("n"), F.sum("_new").cast("long").alias("overlays"))


@query("orphan_edges", "SELECT o_orderkey AS edge FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return table(spark, sf_dir, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select(F.col("o_orderkey").alias("edge"))


@query("website_chunks", rf"""WITH t AS (SELECT url, {strip_sql()} AS content FROM pages), h AS (SELECT *, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM t)
SELECT url AS document_id, concat(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), CASE WHEN path = '' THEN '/' ELSE path END) AS source, sha256(concat_ws(':', url, content)) AS id, length(content) AS n FROM h
WHERE length(trim(content)) >= 100 AND coalesce(list_sum(list_transform(regexp_extract_all(trim(content), '\[[^\]]*\]\([^)]*\)'), lambda x: length(x))), 0) / length(trim(content)) <= 0.5""")
def website_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through the website reader: text, source and id of each that is not poor."""
    from ..sources.readers import website

    return website(table(spark, sf_dir, "pages")).select("document_id", "source", "id", F.length("content").cast("long").alias("n"))


@query("stream_activity", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY event_type")
def stream_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events replayed as a stream, deduplicated by id within the watermark."""
    import uuid

    from ..streaming.ingest import deduplicated, run_to_end

    events = table(spark, sf_dir, "events")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    run_to_end(deduplicated(rows.withColumn("ts", F.col("ts").cast("timestamp")), "event_id", "ts", "60 days"), f"{folder}/out", f"{folder}/state")
    out = spark.read.schema(events.schema).parquet(f"{folder}/out")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query(
    "mounted_collection",
    """WITH c AS (SELECT o_orderkey AS id, o_custkey % 20 AS seg FROM orders), r AS (SELECT seg, 'a' AS collection FROM (SELECT DISTINCT seg FROM c) WHERE seg % 3 <> 0 UNION ALL SELECT seg, 'b' FROM (SELECT DISTINCT seg FROM c) WHERE seg < 12),
m AS (SELECT collection, c.id, c.seg FROM r JOIN c ON c.seg = r.seg WHERE NOT (collection = 'b' AND c.seg IN (3, 4)))
SELECT collection, count(*) AS chunks, CAST(count(*) FILTER (WHERE id % 11 <> 0) AS BIGINT) AS searched, CASE WHEN collection = 'a' THEN (SELECT count(*) FROM c WHERE seg % 3 = 0) ELSE 0 END AS orphans FROM m GROUP BY collection""",
)
def mounted_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection a is mounted by its revision and reconciled; b by its head without two segments, so it is not."""
    from ..operators import store as S

    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("segment_id"))
    all_ = list(range(20))
    heads = spark.createDataFrame([("a", "r1", all_), ("b", "none", [k for k in all_ if k < 12])], "collection string, revision string, segments array<bigint>")
    revisions = spark.createDataFrame([("r1", [k for k in all_ if k % 3])], "revision string, segments array<bigint>")
    refs = S.segment_refs(heads, revisions)
    out = []
    for name, skip in (("a", None), ("b", spark.createDataFrame([(3,), (4,)], "segment_id bigint"))):
        rows, searched = S.mounted(chunks, refs.where(F.col("collection") == name), skip, chunks.where("id % 11 = 0"))
        gone = S.reconciled(chunks.select("id"), rows, skip is not None)
        counts = [rows.agg(F.count("*").alias("chunks")), searched.agg(F.count("*").alias("searched")), gone.agg(F.count("*").alias("orphans"))]
        out.append(counts[0].crossJoin(counts[1]).crossJoin(counts[2]).select(F.lit(name).alias("collection"), "*"))  # one row each
    return out[0].unionByName(out[1])


@query(
    "layer_ids",
    """WITH h AS (SELECT sha256(concat('{"source_id":', l_orderkey, ',"target_id":', l_partkey, ',"type":"references"}')) AS h FROM lineitem)
SELECT sha256(concat_ws(':', 'c1', 'x1', count(*), sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)), sum(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT)), sum(CAST(concat('0x', substr(h, 31, 15)) AS BIGINT)), sum(CAST(concat('0x', substr(h, 46, 15)) AS BIGINT)))) AS layer_id, count(*) AS edges FROM h""",
)
def layer_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import store as S

    edges = table(spark, sf_dir, "lineitem").select(F.lit("references").alias("type"), F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    return S.layer_id(edges, "c1", "x1")


@query("chunker_routing", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'github-issue' WHEN doc_id % 7 < 2 OR doc_id % 5 = 1 THEN 'markdown' WHEN doc_id % 7 < 4 THEN 'hierarchical-code' ELSE 'code-window' END AS chunker FROM documents")
def chunker_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chunking

    d = F.col("doc_id")
    kind = F.when(d % 5 == 0, "github-pr").when(d % 5 == 1, "markdown").otherwise("code")
    path = F.get(F.array(*map(F.lit, ("a/b.md", "README.MDX", "src/x.py", "y.TSX", "z.c", "Makefile"))), (d % 7).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", chunking.chunker_name(kind, path).alias("chunker"))


@query("issue_contexts", r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('acme/r PR ', doc_id, ': ', coalesce(nullif(regexp_extract(concat('# ', text), '^#\s+(.+)', 1), ''), concat('acme/r#', doc_id)), chr(10), '---', chr(10)) WHEN 1 THEN concat('acme/r issue ', doc_id, ': acme/r#', doc_id, chr(10), 'Labels: a,b', chr(10), '---', chr(10))
  ELSE concat('acme/r discussion ', doc_id, ': acme/r/discussions/', doc_id, chr(10), '---', chr(10)) END AS context FROM documents""")
def issue_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import chunking

    d = F.col("doc_id")
    n = d.cast("string")
    kind = F.when(d % 3 == 0, "github-pr").when(d % 3 == 1, "github-issue").otherwise("github-discussion")
    source = F.when(d % 3 == 2, F.concat(F.lit("acme/r/discussions/"), n)).otherwise(F.concat(F.lit("acme/r#"), n))
    content = F.when(d % 3 == 0, F.concat(F.lit("# "), "text")).otherwise(F.lit("no heading"))
    return table(spark, sf_dir, "documents").select("doc_id", chunking.issue_context(kind, source, n, content, F.when(d % 3 == 1, "a,b")).alias("context"))


#: Both runs of ``ingest_runs`` as one SQL statement. A chunk is a window of 2000 characters.
_RUNS = """WITH v AS (SELECT 1 AS run, doc_id, lang, 'v1' AS version, coalesce(text, '') AS text, false AS gone FROM documents WHERE doc_id % 4 <> 3
  UNION ALL SELECT 2, doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN 'v2' ELSE 'v1' END, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 3 = 0 THEN concat('new ', coalesce(text, '')) ELSE coalesce(text, '') END, doc_id % 11 = 0 FROM documents WHERE doc_id % 5 <> 4),
w AS (SELECT *, unnest(range(0, greatest(length(text), 1), 2000)) AS o FROM v),
c AS (SELECT run, doc_id, lang, version, gone, o, substr(text, o + 1, 2000) AS content FROM w),
h AS (SELECT *, sha256(concat_ws(':', doc_id, version, o, content)) AS id, sha256(content) AS fp FROM c),
donor AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 4 = 3 AND doc_id % 7 = 0),
known AS (SELECT id, fp FROM h WHERE run = 1 UNION ALL SELECT sha256(concat_ws(':', doc_id, 'v1', o, s)), sha256(s) FROM (SELECT doc_id, o, substr(text, o + 1, 2000) AS s FROM (SELECT *, unnest(range(0, greatest(length(text), 1), 2000)) AS o FROM donor))),
stored AS (SELECT * FROM h WHERE run = 1 UNION ALL SELECT * FROM h WHERE run = 2 AND id NOT IN (SELECT id FROM known) AND fp NOT IN (SELECT fp FROM known)),
n AS (SELECT doc_id, count(*) AS stored, CAST(count(*) FILTER (WHERE run = 2) AS BIGINT) AS fresh FROM stored GROUP BY doc_id),
a AS (SELECT doc_id, count(DISTINCT version) AS archived FROM (SELECT doc_id, version FROM v WHERE text <> '' UNION ALL SELECT doc_id, 'v1' FROM donor WHERE text <> '') GROUP BY doc_id),
d AS (SELECT run, doc_id, any_value(lang) AS lang, any_value(version) AS version, any_value(gone) AS gone, list(id) AS ids FROM h GROUP BY run, doc_id),
j AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, x.version AS ov, y.version AS nv, x.ids AS oi, y.ids AS ni, coalesce(y.gone, false) AS gone, y.doc_id IS NULL AS absent, coalesce(x.lang, y.lang) = 'de' AS app FROM (SELECT * FROM d WHERE run = 1) x FULL JOIN (SELECT * FROM d WHERE run = 2) y ON x.doc_id = y.doc_id),
k AS (SELECT *, absent OR gone OR (ov = nv AND NOT app) AS keep FROM j WHERE NOT (ov IS NULL AND gone)),"""


@query(
    "ingest_runs",
    f"""{_RUNS}
m AS (SELECT doc_id, CASE WHEN ov IS NULL THEN nv WHEN keep THEN ov ELSE nv END AS version, CAST(CASE WHEN ov IS NULL THEN len(ni) WHEN keep THEN len(oi) WHEN app THEN len(list_distinct(list_concat(oi, ni))) ELSE len(ni) END AS BIGINT) AS chunks,
  CASE WHEN ov IS NULL OR keep OR app THEN '' ELSE ov END AS previous, CAST(CASE WHEN ov IS NULL OR keep OR app THEN 0 ELSE len(list_filter(oi, lambda i: NOT list_contains(ni, i))) END AS BIGINT) AS superseded, CASE WHEN gone OR doc_id % 13 = 0 THEN 'archived' ELSE 'active' END AS state FROM k)
SELECT m.*, coalesce(n.stored, 0) AS stored, coalesce(n.fresh, 0) AS fresh, coalesce(a.archived, 0) AS archived FROM m LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id)""",
)
def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of a collection, the second with donors, tombstones and renames; one of its batches is killed before its commit, another comes twice."""
    import uuid

    from pyspark.errors import StreamingQueryException

    from ..streaming import job as J
    from ..streaming.ingest import stream

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    folder = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    gone, new = F.col("doc_id") % 11 == 0, F.col("doc_id") % 3 == 0

    def chunked(rows: DataFrame) -> DataFrame:
        windows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(2000))))
        content = F.substring("text", F.col("o") + 1, F.lit(2000))
        cut = windows.withColumn("content", content).withColumn("document_id", F.col("doc_id").cast("string"))
        return cut.select(F.sha2(F.concat_ws(":", "document_id", "version", "o", "content"), 256).alias("id"), "document_id", "version", "source_type", "content", F.when(F.col("o") == 0, F.col("text")).alias("raw"), F.sha2("content", 256).alias("fingerprint"), F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("ts"), (F.col("doc_id") * 100_000 + F.col("o")).alias("ord"))

    kind = F.when(F.col("lang") == "de", "hn-story").otherwise("doc-page")
    runs = {
        "first": chunked(docs.where("doc_id % 4 <> 3").select("doc_id", "text", F.lit("v1").alias("version"), kind.alias("source_type"))),
        "second": chunked(docs.where("doc_id % 5 <> 4").select("doc_id", F.when(gone, "").when(new, F.concat(F.lit("new "), "text")).otherwise(F.col("text")).alias("text"), F.when(new, "v2").otherwise("v1").alias("version"), F.when(gone, "tombstone").otherwise(kind).alias("source_type"))),
    }
    others = chunked(docs.where("doc_id % 4 = 3 AND doc_id % 7 = 0").select("doc_id", "text", F.lit("v1").alias("version"), kind.alias("source_type")))
    archives = others.where("raw is not null").select(F.lit("other").alias("collection"), F.lit("blob").alias("storage_id"), F.lit("docs").alias("source_key"), "document_id", "version", "source_type", F.lit(None).cast("map<string,string>").alias("metadata"), F.col("raw").alias("content"))
    catalogs = others.groupBy(F.lit("other").alias("collection"), "document_id").agg(F.collect_list("id").alias("chunk_ids"), F.collect_list("fingerprint").alias("fingerprints"))

    class Killed(J.IngestJob):
        """Dies before the second batch's commit."""

        def commit(self, name: str, body: dict) -> None:
            if name.endswith("-000000001"):
                raise RuntimeError("killed")
            super().commit(name, body)

    for name, rows in runs.items():
        landing = f"{folder}/landing/{name}"
        rows.write.parquet(landing)
        if len(spark.read.parquet(landing).inputFiles()) < 3:  # too few for the batch that is killed
            rows.repartition(3, "ord").write.mode("overwrite").parquet(landing)
        batch = -(-len(spark.read.parquet(landing).inputFiles()) // 3)
        start = lambda kind: kind(spark, f"{folder}/collection", name, "docs", append_only=("hn-story",))  # noqa: B023, E731
        if name == "second":
            try:
                job = start(Killed)
                job.reuse_donors(archives, catalogs)
                job.stream(stream(spark, landing, rows.schema, batch)).awaitTermination()
            except StreamingQueryException as e:
                if "killed" not in str(e):
                    raise
        job = start(J.IngestJob)
        job.stream(stream(spark, landing, rows.schema, batch)).awaitTermination()
        job.step(spark.read.schema(rows.schema).parquet(landing).limit(1), 0)  # a batch that was committed changes nothing
        job.finish(docs.where("doc_id % 13 = 0").select(F.col("doc_id").cast("string").alias("document_id")) if name == "second" else None)
    count = lambda t, of: job.table(t).groupBy("document_id").agg(*of)
    second = job.table("chunks", own=True).groupBy("document_id").agg(F.count("*").alias("fresh"))
    out = job.table("catalog").join(count("chunks", [F.count("*").alias("stored")]), "document_id", "left").join(second, "document_id", "left").join(count("archive", [F.count("*").alias("archived")]), "document_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("document_id").cast("long").alias("doc_id"), "version", F.size("chunk_ids").cast("long").alias("chunks"), F.array_join("previous", ",").alias("previous"), F.size("superseded").cast("long").alias("superseded"), "state", zero("stored"), zero("fresh"), zero("archived"))


@query(
    "renamed_files",
    """WITH RECURSIVE g AS (SELECT concat('old/', lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS path, coalesce(text, '') AS t FROM documents WHERE doc_id % 3 = 0),
c AS (SELECT concat('new/', lpad(CAST(doc_id AS VARCHAR), 9, '0')) AS path, CASE WHEN doc_id % 2 = 0 THEN concat(coalesce(text, ''), chr(10), 'a line more') ELSE coalesce(text, '') END AS t FROM documents WHERE doc_id % 9 < 4),
same AS (SELECT a.path AS from_path, b.path FROM (SELECT path, t, row_number() OVER (PARTITION BY t ORDER BY path) AS k FROM g) a JOIN (SELECT path, t, row_number() OVER (PARTITION BY t ORDER BY path) AS k FROM c) b ON a.t = b.t AND a.k = b.k),
x AS (SELECT path, l, count(*) AS n FROM (SELECT path, unnest(string_split(t, chr(10))) AS l FROM g WHERE path NOT IN (SELECT from_path FROM same)) GROUP BY ALL),
y AS (SELECT path, l, count(*) AS n FROM (SELECT path, unnest(string_split(t, chr(10))) AS l FROM c WHERE path NOT IN (SELECT path FROM same)) GROUP BY ALL),
sx AS (SELECT path, sum(n * (strlen(l) + 1)) AS s FROM x GROUP BY path), sy AS (SELECT path, sum(n * (strlen(l) + 1)) AS s FROM y GROUP BY path),
m AS (SELECT x.path AS from_path, y.path, sum(least(x.n, y.n) * (strlen(x.l) + 1)) AS common FROM x JOIN y ON x.l = y.l GROUP BY ALL),
p AS MATERIALIZED (SELECT from_path, m.path, common / greatest(sx.s, sy.s) AS likeness, row_number() OVER (ORDER BY common / greatest(sx.s, sy.s) DESC, from_path, m.path) AS k FROM m JOIN sx ON sx.path = from_path JOIN sy ON sy.path = m.path WHERE common / greatest(sx.s, sy.s) >= 0.5),
w(k, froms, tos) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[] UNION ALL SELECT p.k, CASE WHEN list_contains(froms, from_path) OR list_contains(tos, path) THEN froms ELSE list_append(froms, from_path) END,
  CASE WHEN list_contains(froms, from_path) OR list_contains(tos, path) THEN tos ELSE list_append(tos, path) END FROM w JOIN p ON p.k = w.k + 1),
z AS (SELECT unnest(froms) AS from_path, unnest(tos) AS path FROM (SELECT froms, tos FROM w ORDER BY k DESC LIMIT 1))
SELECT from_path, path, 1.0::DOUBLE AS likeness FROM same UNION ALL SELECT z.from_path, z.path, round(likeness, 6) FROM z JOIN p ON p.from_path = z.from_path AND p.path = z.path""",
)
def renamed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the documents removed; others, copies of them among these, added, every second with a line more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    path = lambda folder: F.concat(F.lit(folder), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("path")
    gone = docs.where("doc_id % 3 = 0").select(path("old/"), F.col("t").alias("content"))
    come = docs.where("doc_id % 9 < 4").select(path("new/"), F.when(F.col("doc_id") % 2 == 0, F.concat("t", F.lit("\na line more"))).otherwise(F.col("t")).alias("content"))
    return I.renames(gone, come).withColumn("likeness", F.round("likeness", 6))
