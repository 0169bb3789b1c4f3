"""Quality evaluation of corpora, retrieval and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import sized


def ingest_quality(chunks: DataFrame) -> DataFrame:
    """For each source type: counts, missing fields, length statistics (exact median), very short and very long chunks."""
    n = F.length("content")
    return chunks.groupBy("source_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("content").isNull() | (F.trim("content") == "")).alias("blank"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"),
        F.avg(n).alias("mean"), F.percentile(n, F.lit(0.5)).alias("median"), F.count_if(n < 50).alias("short"), F.count_if(n > 10000).alias("long"),
    )


def reciprocal_ranks(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank): the first rank of an expected item; null if there is none. ranked: query_id, id, rank; expected: query_id, id."""
    hit = ranked.join(expected, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return expected.select("query_id").distinct().join(hit, "query_id", "left")


def pass_breakdown(scores: DataFrame, *by: str) -> DataFrame:
    """Pass rates in all, by each dimension and by all of them, in one scan."""
    sets = [[], *([b] for b in by), list(by)]
    return scores.groupingSets(sets, *by).agg(F.count("*").alias("n"), F.sum(F.col("passed").cast("long")).alias("passed"))


def coherence(hops: DataFrame) -> DataFrame:
    """Parent and child pairs by edge type: how many are dated, and how many go forward in time."""
    parent = hops.select("query_id", F.col("hop_index").alias("parent_hop_index"), F.col("ts").alias("parent_ts"))
    pairs = hops.where("parent_hop_index >= 0").join(parent, ["query_id", "parent_hop_index"])
    return pairs.groupBy("edge_type").agg(F.count("*").alias("pairs"), F.count_if(F.col("ts").isNotNull() & F.col("parent_ts").isNotNull()).alias("dated"), F.count_if(F.col("ts") >= F.col("parent_ts")).alias("forward"))


def monotonic(hops: DataFrame) -> DataFrame:
    """For each trace whether its dated hops go forward in time; null with fewer than two."""
    w = Window.partitionBy("query_id").orderBy("hop_index")
    rows = hops.where("ts is not null").withColumn("back", (F.col("ts") < F.lag("ts").over(w)).cast("int"))
    return rows.groupBy("query_id").agg(F.when(F.count("*") >= 2, F.coalesce(F.max("back"), F.lit(0)) == 0).alias("monotonic"))


def preflight(queries: DataFrame, corpora: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, corpus, status): invalid without required artifacts, applicable if the corpus has all of them active, else skipped.

    queries: query_id, required (array); corpora: corpus; catalog: corpus,
    artifact, state. Test queries and corpora are small; the catalog is joined
    by (corpus, artifact).
    """
    grid = queries.crossJoin(sized(corpora, limit=10_000))
    need = grid.select("query_id", "corpus", F.explode("required").alias("artifact"))
    found = need.join(catalog.where("state = 'active'").select("corpus", "artifact", F.lit(1).alias("hit")).distinct(), ["corpus", "artifact"], "left")
    counts = found.groupBy("query_id", "corpus").agg(F.count("hit").alias("have"))
    rows = grid.join(counts, ["query_id", "corpus"], "left")
    status = F.when(F.size("required") == 0, "invalid").when(F.col("have") == F.size("required"), "applicable").otherwise("skipped")
    return rows.select("query_id", "corpus", status.alias("status"))


def hard_negative_passes(ranked: DataFrame) -> DataFrame:
    """A hard negative passes with under three results of 0.1 or more and a top score under 0.6."""
    return ranked.groupBy("query_id").agg(((F.count_if(F.col("score") >= 0.1) < 3) & (F.max("score") < 0.6)).alias("passed"))


def diagnosis(counts: DataFrame, classes: list[str]) -> DataFrame:
    """Counts of failure classes with zeros, and the share of the dominant one (the first in the given order on ties)."""
    order = counts.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], "class string, ord int")
    rows = order.join(counts, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.withColumn("share", F.coalesce(F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy()), F.lit(0)), F.lit(0.0))).select("class", "n", "share")
