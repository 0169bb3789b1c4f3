"""Trace queries: customers, orders and parts are a graph; events and orders are hops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import trace as T
from ..registry import query, table


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order to customer and back, order to part."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    o, c, p = F.concat(F.lit("o"), "o_orderkey"), F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("p"), "l_partkey")
    lo = F.concat(F.lit("o"), "l_orderkey")
    rows = orders.select(o.alias("node"), c.alias("other"), F.lit("placed-by").alias("type"), F.lit("forward").alias("direction"), F.col("o_orderkey").alias("seq"))
    rows = rows.unionByName(orders.select(c.alias("node"), o.alias("other"), F.lit("placed-by").alias("type"), F.lit("reverse").alias("direction"), F.col("o_orderkey").alias("seq")))
    return rows.unionByName(lines.select(lo.alias("node"), p.alias("other"), F.lit("contains").alias("type"), F.lit("forward").alias("direction"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")))


_GRAPH = """g AS (SELECT DISTINCT concat('o', o_orderkey) AS node, concat('c', o_custkey) AS other FROM orders UNION SELECT concat('c', o_custkey), concat('o', o_orderkey) FROM orders
  UNION SELECT concat('o', l_orderkey), concat('p', l_partkey) FROM lineitem)"""


@query(
    "graph_reachability",
    f"""WITH RECURSIVE {_GRAPH}, r(q, node, depth) AS (SELECT o_orderkey, concat('o', o_orderkey), 0 FROM orders WHERE o_orderkey % 50 = 0
  UNION SELECT r.q, g.other, r.depth + 1 FROM r JOIN g ON g.node = r.node WHERE r.depth < 3)
SELECT query_id, depth, count(*) AS n FROM (SELECT q AS query_id, node, min(depth) AS depth FROM r GROUP BY q, node) GROUP BY query_id, depth""",
)
def graph_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return T.reachable(seeds, _graph(spark, sf_dir)).groupBy("query_id", "depth").agg(F.count("*").alias("n"))


@query("trace_depth_first")
def trace_depth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.floor(F.col("o_orderkey") / 200).alias("query_id"), F.concat(F.lit("o"), "o_orderkey").alias("node"), F.col("o_orderkey").alias("ord"))
    return T.depth_first(seeds, _graph(spark, sf_dir))


def _hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as traces of 15 hops, named by user and number: hop n came from hop n // 2."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.row_number().over(w) - 1
    rows = events.withColumn("trace", F.floor(n / T.MAX_TOTAL)).withColumn("hop_index", n % T.MAX_TOTAL)
    parent = F.when(F.col("hop_index") % 5 == 0, -1).otherwise(F.floor(F.col("hop_index") / 2)).cast("int")
    kind = F.when(F.col("hop_index") % 5 == 0, "semantic").otherwise("edge")
    return rows.select(
        F.concat_ws("-", "user_id", "trace").alias("query_id"), "hop_index", parent.alias("parent_hop_index"), F.col("event_type").alias("source_type"), F.concat(F.lit("s"), F.col("event_id") % 7).alias("source"),
        F.when(F.col("event_id") % 4 != 0, F.date_trunc("hour", "ts")).alias("ts"), kind.alias("method"), F.when(F.col("event_id") % 3 == 0, "closes").otherwise("references").alias("edge_type"), F.col("value").alias("confidence"), F.col("ts").alias("raw_ts"),
    )


_HOPS = """h AS (SELECT concat(user_id, '-', n // 15) AS query_id, i AS hop_index, CASE WHEN i % 5 = 0 THEN -1 ELSE i // 2 END AS parent_hop_index, event_type AS source_type, concat('s', event_id % 7) AS source,
  CASE WHEN event_id % 4 <> 0 THEN date_trunc('hour', ts) END AS ts, CASE WHEN i % 5 = 0 THEN 'semantic' ELSE 'edge' END AS method, CASE WHEN event_id % 3 = 0 THEN 'closes' ELSE 'references' END AS edge_type, value AS confidence
  FROM (SELECT *, n % 15 AS i FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)))"""


@query("chronological_order", f"WITH {_HOPS} SELECT query_id, CAST(hop_index AS INTEGER) AS hop_index, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ts ASC NULLS LAST, hop_index) - 1 AS INTEGER) AS chrono FROM h")
def chronological_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chronological(_hops(spark, sf_dir)).select("query_id", "hop_index", "chrono")


@query(
    "lineage_chains",
    f"""WITH RECURSIVE {_HOPS}, p(query_id, leaf, above, path, kinds) AS (
  SELECT query_id, hop_index, parent_hop_index, CAST(hop_index AS VARCHAR), [source_type] FROM h WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.query_id = h.query_id AND c.parent_hop_index = h.hop_index)
  UNION ALL SELECT p.query_id, p.leaf, u.parent_hop_index, concat(u.hop_index, '>', p.path), list_concat([u.source_type], p.kinds) FROM p JOIN h u ON u.query_id = p.query_id AND u.hop_index = p.above)
SELECT query_id, CAST(leaf AS INTEGER) AS leaf, path, array_to_string(list_transform(list_filter(range(1, len(kinds) + 1), lambda i: i = 1 OR kinds[i] <> kinds[i - 1]), lambda i: kinds[i]), '>') AS types, CAST(len(list_distinct(kinds)) AS INTEGER) AS variety FROM p WHERE above < 0""",
)
def lineage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.lineage(_hops(spark, sf_dir))
    return out.select("query_id", "leaf", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.array_join("types", ">").alias("types"), "variety")


@query(
    "trace_conclusion",
    f"""WITH {_HOPS}, q AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC NULLS LAST, hop_index) AS r FROM h WHERE parent_hop_index < 0)
SELECT query_id, 'primary' AS role, CAST(hop_index AS INTEGER) AS hop_index FROM q WHERE r = 1 UNION ALL SELECT query_id, 'fix', CAST(hop_index AS INTEGER) FROM h WHERE edge_type = 'closes'
UNION ALL SELECT query_id, 'next', CAST(hop_index AS INTEGER) FROM h WHERE parent_hop_index >= 0 AND NOT EXISTS (SELECT 1 FROM h c WHERE c.query_id = h.query_id AND c.parent_hop_index = h.hop_index)""",
)
def trace_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.conclusion(_hops(spark, sf_dir))


@query(
    "display_links",
    f"""WITH {_HOPS} SELECT a.query_id, CAST(a.hop_index AS INTEGER) AS hop_index, CAST(min(b.hop_index) AS INTEGER) AS "to" FROM h a JOIN h b ON a.query_id = b.query_id AND b.method = 'edge'
WHERE (a.method = 'edge' AND b.hop_index > a.hop_index AND b.source <> a.source) OR (a.method = 'semantic' AND b.source_type = a.source_type) GROUP BY a.query_id, a.hop_index""",
)
def display_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.display_links(_hops(spark, sf_dir))


@query("convergence", "SELECT user_id, n AS kinds, round(least(0.5 + 0.1 * n, 1.0), 4)::DOUBLE AS strength FROM (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id) WHERE n >= 3")
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"))
    return kinds.withColumn("strength", F.round(T.convergence(F.col("kinds")), 4)).where("strength is not null")


@query(
    "temporal_cluster",
    """SELECT user_id, dated, recent, round(least(0.4 + 0.5 * recent / dated, 1.0), 6)::DOUBLE AS strength FROM (
  SELECT user_id, count(d) AS dated, CAST(count(*) FILTER (WHERE d >= TIMESTAMP '2024-01-14 00:00:00') AS BIGINT) AS recent FROM (SELECT user_id, CASE WHEN event_id % 4 <> 0 THEN ts END AS d FROM events) GROUP BY user_id) WHERE recent >= 2 AND recent / dated >= 0.5""",
)
def temporal_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops of the 30 days before 2024-02-13; the reference time is a parameter, never the clock."""
    rows = table(spark, sf_dir, "events").withColumn("d", F.when(F.col("event_id") % 4 != 0, F.col("ts"))).groupBy("user_id").agg(F.count("d").alias("dated"), F.count_if(F.col("d") >= F.lit("2024-01-14 00:00:00").cast("timestamp")).alias("recent"))
    return rows.withColumn("strength", F.round(T.recency(F.col("dated"), F.col("recent")), 6)).where("strength is not null")


@query("chain_ranking", f"""WITH RECURSIVE {_HOPS}, p(query_id, leaf, above, kinds) AS (
  SELECT query_id, hop_index, parent_hop_index, [source_type] FROM h WHERE NOT EXISTS (SELECT 1 FROM h c WHERE c.query_id = h.query_id AND c.parent_hop_index = h.hop_index)
  UNION ALL SELECT p.query_id, p.leaf, u.parent_hop_index, list_concat([u.source_type], p.kinds) FROM p JOIN h u ON u.query_id = p.query_id AND u.hop_index = p.above)
SELECT query_id, CAST(leaf AS INTEGER) AS leaf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY len(kinds) DESC, len(list_distinct(kinds)) DESC, leaf) AS INTEGER) AS place FROM p WHERE above < 0""")
def chain_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.ranked_chains(T.lineage(_hops(spark, sf_dir))).select("query_id", "leaf", "place")


def trace_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, chunks (vectors with their document's language and source) and edges: each vector cites two others, both ways."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("source_type"), "source", F.to_timestamp(F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))).alias("ts"))
    chunks = vectors.join(docs, "id").withColumn("ord", F.col("id"))
    n = chunks.count()
    both = F.array(F.struct(F.lit("references").alias("type"), ((F.col("id") * 7 + 3) % n).alias("to")), F.struct(F.lit("closes").alias("type"), ((F.col("id") * 13 + 5) % n).alias("to")))
    cited = chunks.select("id", F.posexplode(both).alias("k", "x")).select("id", "x.type", "x.to", (F.col("id") * 2 + F.col("k")).alias("seq"))
    forward = cited.select(F.col("id").alias("node"), F.col("to").alias("other"), "type", F.lit("forward").alias("direction"), "seq")
    back = cited.select(F.col("to").alias("node"), F.col("id").alias("other"), "type", F.lit("reverse").alias("direction"), "seq")
    edges = forward.unionByName(back).withColumns({"evidence": F.concat_ws(" ", "type", "other"), "confidence": F.lit(0.9)})
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return queries, chunks, edges


@query("trace")
def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50, traced through all chunks; tests hold it against a plain walk."""
    return T.trace(*trace_tables(spark, sf_dir), min_score=0.05, type_boosts={"en": 0.8}, diverse=True)


@query("trace_insights")
def trace_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    hops = T.trace(*trace_tables(spark, sf_dir), min_score=0.05)
    return T.insights(hops, F.lit("2024-01-10").cast("timestamp"))
