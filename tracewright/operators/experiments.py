"""Experiment rows: failure diagnosis, regressions, candidate labels, proposals, fingerprints, grounding, storage and resolution reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import sized

# Thresholds, classes, labels and the settings that may be proposed.
SLOW_MS = 8000
LAYERS = {
    "slow-but-passing": "ranking", "fixture-invalid": "fixture", "hard-negative-violated": "ranking", "retrieval-miss": "embedding", "retrieved-not-ranked": "ranking",
    "missing-edge": "trace", "answer-synthesis": "trace",
}
KEEPER_RANKS = (4, 20)
TRACE_TYPES = ["trace", "causal", "compare"]
REGRESSION_PROBABILITY, REGRESSION_DELTA, LEAST_BASELINE = 0.95, 0.04, 3
CATEGORIES = {"lookup": "direct-lookup", "trace": "cross-source", "compare": "cross-source", "temporal": "cross-source", "causal": "cross-source", "howto": "synthesis", "entity-resolution": "coverage"}
PATCH_PATHS, PATCH_LINES = ["packages/search/src/"], 200
KNOBS = [
    ("autoRoute", "boolean", None, None, []),
    ("diversityEnforce", "boolean", None, None, []),
    ("reranker", "enum", None, None, ["off", "llm:haiku", "bge"]),
    ("topK", "int", 5.0, 30.0, []),
    ("traceMaxPerSource", "int", 1.0, 10.0, []),
    ("traceMaxTotal", "int", 5.0, 50.0, []),
    ("traceMinScore", "float", 0.1, 0.6, []),
]


def diagnosed(scores: DataFrame, slow_ms: float | None = SLOW_MS) -> DataFrame:
    """``failure_class`` and ``layer`` of each query that failed, or passed too slowly; other rows go.

    scores: skipped, passed, passed_query_only, required_types,
    substring_found, document_id_found, canonical, edge_hop_found,
    require_edge_hop, hard_negative (booleans), probed (whether the wider
    retrieval was recorded), gold_rank, top_k, duration_ms, preflight.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    slow = F.lit(False) if slow_ms is None else F.coalesce(F.col("duration_ms") > slow_ms, F.lit(False))
    evidence = F.when(yes("canonical"), yes("document_id_found")).otherwise(yes("substring_found"))
    rank = F.col("gold_rank")
    kind = (
        F.when(yes("skipped"), None)
        .when(yes("passed"), F.when(slow, "slow-but-passing"))
        .when(F.coalesce(F.col("preflight") == "invalid", F.lit(False)), "fixture-invalid")
        .when(yes("hard_negative"), "hard-negative-violated")
        .when(yes("probed") & rank.isNull(), "retrieval-miss")
        .when(yes("probed") & F.coalesce(rank > F.col("top_k"), F.lit(False)), "retrieved-not-ranked")
        .when(yes("passed_query_only"), "missing-edge")
        .when(~yes("required_types") | ~evidence, "retrieved-not-ranked")
        .otherwise("answer-synthesis")
    )
    layers = F.create_map(*(F.lit(x) for kv in LAYERS.items() for x in kv))
    rows = scores.withColumn("failure_class", kind).where("failure_class is not null")
    no_edge = (F.col("failure_class") == "missing-edge") & yes("require_edge_hop") & ~yes("edge_hop_found")
    return rows.withColumn("layer", F.when(no_edge, "edge-extraction").otherwise(F.element_at(layers, F.col("failure_class"))))


def regressions(runs: DataFrame, results: DataFrame, iterations: int = 5000, least: int = LEAST_BASELINE) -> DataFrame:
    """(variant, corpus, latest, baseline, wins, status) for each variant and corpus.

    runs: run, variant, corpus, fingerprint, logged_at, breach (whether a hard
    gate failed); results: run, family, passed (0 to 1). The latest run is
    compared with each earlier one of its fingerprint by a paired bootstrap
    over the families that both have: a baseline wins if its mean lead is
    0.04 or more and it leads in 95 % of the draws. A majority of winning
    baselines is a regression; fewer than ``least`` baselines tell nothing.
    Draws come from a hash of (iteration, draw), as in the bootstrap of pairs.
    """
    of = ["variant", "corpus"]
    last = runs.groupBy(*of).agg(F.max(F.struct("logged_at", "run", "fingerprint", "breach")).alias("x")).select(*of, F.col("x.run").alias("latest"), F.col("x.fingerprint").alias("print"), F.col("x.breach").alias("breach"))
    earlier = runs.join(last, of).where("run <> latest and fingerprint = print").select(*of, "latest", "run")
    new = results.select(F.col("run").alias("latest"), "family", F.col("passed").alias("new"))
    pairs = earlier.join(new, "latest").join(results.select("run", "family", F.col("passed").alias("old")), ["run", "family"])
    place = F.row_number().over(Window.partitionBy(*of, "run").orderBy("family")) - 1
    pairs = pairs.select(*of, "run", place.cast("long").alias("pos"), (F.col("old") - F.col("new")).alias("d"))
    sizes = pairs.groupBy(*of, "run").agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    draws = sizes.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    at = F.conv(F.substring(F.sha2(F.concat_ws(":", "iteration", "draw"), 256), 1, 13), 16, 10).cast("long") % F.col("n")
    drawn = draws.select(*of, "run", "iteration", at.alias("pos")).join(pairs, [*of, "run", "pos"])
    leads = drawn.groupBy(*of, "run", "iteration").agg(F.avg("d").alias("lead")).groupBy(*of, "run").agg(F.avg("lead").alias("delta"), F.avg((F.col("lead") > 0).cast("double")).alias("ahead"))
    won = (F.col("ahead") >= REGRESSION_PROBABILITY) & (F.col("delta") >= REGRESSION_DELTA)
    told = leads.groupBy(*of).agg(F.count("*").alias("baseline"), F.count_if(won).alias("wins"))
    rows = last.join(told, of, "left").withColumns({"baseline": F.coalesce("baseline", F.lit(0)), "wins": F.coalesce("wins", F.lit(0))})
    lost = F.col("wins") >= F.floor(F.col("baseline") / 2) + 1
    counted = earlier.groupBy(*of).agg(F.count("*").alias("candidates"))
    rows = rows.join(counted, of, "left")
    short = F.col("baseline") < least
    status = (
        F.when(F.coalesce("candidates", F.lit(0)) < least, "insufficient-history")
        .when(short, F.when(F.col("breach"), "breach").otherwise("insufficient-history"))
        .when(F.col("breach") & lost, "both").when(F.col("breach"), "breach").when(lost, "regression").otherwise("ok")
    )
    return rows.select(*of, "latest", "baseline", "wins", status.alias("status"))


def candidate_label(query_type: Column, gold_rank: Column, by_trace: Column, hops: Column, covered: Column) -> Column:
    """struct(label, reasons) of a candidate query after its probe."""
    low, high = KEEPER_RANKS
    fixes = F.array_compact(F.array(F.when(query_type.isin(TRACE_TYPES) & (hops == 0), "unsupported-schema"), F.when(~covered, "retrieval-failure")))
    out = lambda label, *more: F.struct(F.lit(label).alias("label"), F.concat(fixes, F.array(*map(F.lit, more)).cast("array<string>")).alias("reasons"))
    lone = lambda label, reason: F.struct(F.lit(label).alias("label"), F.array(F.lit(reason)).alias("reasons"))
    return (
        F.when(gold_rank.isNull() & ~by_trace, lone("auto-reject", "unsupported-data"))
        .when(F.coalesce(gold_rank < low, F.lit(False)), out("trivial-suspect", "trivial-low-signal"))
        .when(gold_rank.isNull(), out("human-review", "retrieval-failure"))
        .when(F.size(fixes) > 0, out("needs-fix"))
        .when(gold_rank <= high, out("keeper-candidate"))
        .otherwise(out("human-review", "retrieval-failure"))
    )


def keeps(label: Column, override: Column, include_review: bool = False, include_fix: bool = False, force: bool = False) -> Column:
    """Whether a labelled candidate is applied; a person's override always is."""
    allowed = ["keeper-candidate", *(["human-review"] if include_review else []), *(["needs-fix"] if include_fix or force else []), *(["trivial-suspect", "auto-reject"] if force else [])]
    return F.coalesce(override, F.lit(False)) | label.isin(allowed)


def display_category(query_type: Column, hard_negative: Column, hints: Column) -> Column:
    plain = F.element_at(F.create_map(*(F.lit(x) for kv in CATEGORIES.items() for x in kv)), query_type)
    chunking = (query_type == "lookup") & (F.size(hints) == 1) & (F.get(hints, F.lit(0)) == "chunking")
    lineage = (query_type == "trace") & F.array_contains(hints, "edge-extraction") & F.array_contains(hints, "trace")
    return F.when(F.coalesce(hard_negative, F.lit(False)), "hard-negative").when(chunking, "file-level").when(lineage, "work-lineage").otherwise(plain)


def applicable(strata: DataFrame, templates: DataFrame) -> DataFrame:
    """(stratum, template): templates (template, patterns: array of struct(source_type, edge_type, rarity) with nulls for anything) that apply to strata (stratum and those three).

    Templates are a list that somebody wrote; they are broadcast after a count.
    """
    fits = lambda p, c: p[c].isNull() | p[c].eqNullSafe(F.col(c))
    any_fits = (F.coalesce(F.size("patterns"), F.lit(0)) <= 0) | F.exists("patterns", lambda p: fits(p, "source_type") & fits(p, "edge_type") & fits(p, "rarity"))
    return strata.crossJoin(sized(templates, limit=10_000)).where(any_fits).select("stratum", "template")


def patch_problems(patches: DataFrame, allowed: list[str] | None = None, most: int = PATCH_LINES) -> DataFrame:
    """``problems`` and ``lines`` of patches (base_sha, edits: array of struct(file, old, new))."""
    lines = lambda s: F.when(F.length(s) == 0, 0).otherwise(F.regexp_count(s, F.lit("\n")) + 1)
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    problem = lambda e: F.when(blank(e["file"]), "file").when(e["old"].isNull() | e["new"].isNull(), "strings").when(blank(e["old"]), "anchor").when(e["old"] == e["new"], "no-op")
    sound = F.filter("edits", lambda e: problem(e).isNull())
    outside = F.filter(F.array_distinct(F.transform(sound, lambda e: e["file"])), lambda f: ~F.exists(F.array(*map(F.lit, allowed or PATCH_PATHS)), lambda p: F.startswith(f, p)))
    total = F.aggregate(sound, F.lit(0), lambda n, e: n + lines(e["old"]) + lines(e["new"]))
    none = F.coalesce(F.size("edits"), F.lit(0)) <= 0
    every = F.concat(
        F.when(F.coalesce(F.length("base_sha"), F.lit(0)) < 7, F.array(F.lit("base"))).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.transform("edits", problem)), F.transform(outside, lambda _: F.lit("path")),
        F.when(total > most, F.array(F.lit("size"))).otherwise(F.array().cast("array<string>")),
    )
    return patches.withColumn("problems", F.when(none, F.array(F.lit("empty"))).otherwise(every)).withColumn("lines", F.when(none, 0).otherwise(total))


def knob_problem(proposals: DataFrame) -> DataFrame:
    """``problem`` (null if sound) of proposed settings (name, kind of the value, value as text)."""
    spark = proposals.sparkSession
    known = spark.createDataFrame(KNOBS, "knob string, type string, low double, high double, options array<string>")
    rows = proposals.join(F.broadcast(known), F.col("name") == F.col("knob"), "left")  # seven rows
    number = F.col("value").try_cast("double")
    within = number.between(F.col("low"), F.col("high"))
    problem = (
        F.when(F.col("knob").isNull(), "unknown")
        .when(F.col("type") == "boolean", F.when(F.col("kind") != "boolean", "type"))
        .when(F.col("type") == "int", F.when((F.col("kind") != "number") | number.isNull() | (number != F.floor(number)), "type").when(~within, "range"))
        .when(F.col("type") == "float", F.when((F.col("kind") != "number") | number.isNull(), "type").when(~within, "range"))
        .when(F.col("kind") != "string", "type")
        .when(~F.array_contains("options", F.col("value")), "option")
    )
    return rows.withColumn("problem", problem).drop("knob", "type", "low", "high", "options")


def fingerprint(config: Column, version: int = 1) -> Column:
    """The sha256 of a JSON text with all keys in order, below its version: the same for the same settings however written."""
    return F.sha2(F.concat(F.lit('{"config":'), F.to_json(F.parse_json(config)), F.lit(f',"v":{version}}}')), 256)


def model_json(answer: Column) -> Column:
    """The JSON of a model's answer: the whole text, else a fenced block, else from the first [ to the last ], else from { to }; null if none parses.

    An object whose only value is an array stands for that array.
    """

    def parsed(text: Column) -> Column:
        values = F.map_values(F.from_json(text, "map<string,string>"))
        lone = F.when(F.startswith(F.ltrim(text), F.lit("{")) & (F.size(values) == 1) & F.startswith(F.get(values, F.lit(0)), F.lit("[")), F.get(values, F.lit(0)))
        good = F.try_parse_json(text)
        return F.when(good.isNotNull(), F.to_json(F.coalesce(F.try_parse_json(lone), good)))

    t = F.trim(answer)
    between = lambda a, b: F.nullif(F.regexp_extract(t, rf"(?s){a}.*{b}", 0), F.lit(""))
    fenced = F.nullif(F.trim(F.regexp_extract(t, r"```(?:json)?\s*([\s\S]*?)```", 1)), F.lit(""))
    return F.coalesce(parsed(t), parsed(fenced), parsed(between(r"\[", r"\]")), parsed(between(r"\{", r"\}")))


def grounding(grades: DataFrame) -> DataFrame:
    """One row: queries, claims, supported, partial, unsupported and the mean share of unsupported claims; grades: query_id, verdict (null for a query without claims), failed."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    each = grades.where(~F.coalesce("failed", F.lit(False))).groupBy("query_id").agg(F.count("verdict").alias("claims"), *(count(v).alias(v) for v in ("supported", "partial", "unsupported")))
    share = F.when(F.col("claims") > 0, F.col("unsupported") / F.col("claims")).otherwise(0.0)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("claims", "supported", "partial", "unsupported")]
    return each.agg(F.count("*").alias("queries"), *sums, F.coalesce(F.avg(share), F.lit(0.0)).alias("hallucination"))


def storage_report(segments: DataFrame, edges: DataFrame, layers: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: segments, failures (without chunks or edges arrays), chunks, edges, dangling, orphans, verdict.

    segments: segment_id, chunks (array of ids) and edges (array), null where
    they could not be read; edges: source_id of derived edges; layers: read
    (boolean); catalog: chunk_ids.
    """
    bad = F.col("chunks").isNull() | F.col("edges").isNull()
    total = segments.agg(F.count("*").alias("segments"), F.count_if(bad).alias("failures"), F.sum(F.when(~bad, F.size("chunks")).otherwise(0)).cast("long").alias("chunks"), F.sum(F.when(~bad, F.size("edges")).otherwise(0)).cast("long").alias("edges"))
    known = segments.where(~bad).select(F.explode("chunks").alias("id")).distinct()
    dangling = edges.join(known, F.col("source_id") == F.col("id"), "left_anti").agg(F.count("*").alias("dangling"))
    orphans = catalog.select(F.explode("chunk_ids").alias("c")).join(known, F.col("c") == F.col("id"), "left_anti").agg(F.count("*").alias("orphans"))
    unread = layers.agg(F.count_if(~F.col("read")).alias("unread"))
    rows = total.crossJoin(dangling).crossJoin(orphans).crossJoin(unread)  # one row each
    return rows.withColumn("verdict", F.when(F.col("failures") > 0, "fail").when((F.col("dangling") > 0) | (F.col("orphans") > 0), "warn").otherwise("pass"))


def resolution_report(edges: DataFrame) -> DataFrame:
    """One row of rates over edges (class as by ``edges.edge_class``, from_type, to_type of the resolved chunk or null)."""
    count = lambda c: F.count_if(F.col("class") == c)
    sums = edges.agg(F.count("*").alias("edges"), *(count(c).alias(c) for c in ("resolved", "bare", "concept", "package", "url")), F.count_if((F.col("class") != "bare") & F.col("to_type").isNotNull() & (F.col("to_type") != F.col("from_type"))).alias("crossing"))
    rate = lambda below: F.coalesce(F.when(below > 0, F.col("resolved") / below), F.lit(0.0))
    n, adjusted = F.col("edges"), F.col("edges") - F.col("concept") - F.col("bare")
    rows = sums.withColumns({"rate": rate(n), "adjusted": rate(adjusted), "in_scope": rate(adjusted - F.col("package") - F.col("url")), "bare_rate": F.coalesce(F.when(n > 0, F.col("bare") / n), F.lit(0.0)), "density": F.coalesce(F.when(F.col("resolved") > 0, F.col("crossing") / F.col("resolved")), F.lit(0.0))})
    return rows.withColumn("verdict", F.when(n == 0, "pass").when(F.col("rate") < 0.05, "fail").when(F.col("rate") < 0.23, "warn").otherwise("pass"))


def resolution_by_type(edges: DataFrame) -> DataFrame:
    """(from_type, n, resolved, rate): bare references and concepts never count as resolved."""
    hit = F.count_if(~F.col("class").isin("bare", "concept") & F.col("to_type").isNotNull())
    return edges.where("from_type is not null").groupBy("from_type").agg(F.count("*").alias("n"), hit.alias("resolved"), (hit / F.count("*")).alias("rate"))


def documents_of(chunks: DataFrame) -> DataFrame:
    """(storage_id, document_id): the last chunk in order names a storage id's document."""
    return chunks.groupBy("storage_id").agg(F.max_by("document_id", "ord").alias("document_id"))
