"""Typed edges: extraction from text, merging, resolution against chunks, acceptance gates.

An edge has type, source_id, target_type, target_id, evidence, confidence;
``seq`` makes insertion order explicit where an operator depends on it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed, sized

KEY = ["type", "source_id", "target_type", "target_id"]

# The patterns and word lists below define the edge formats.
REPO = r"[a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+"
CLOSES = rf"(?i)\b(?:closes|close|closed|fix|fixes|fixed|resolve|resolves|resolved)\s+(?:({REPO})#(\d+)|#(\d+))"
#: ({REPO})#(\d+), told not to try again within a run of letters that it has failed at the start of.
CROSS = r"(?:\G|(?<![a-zA-Z0-9._-]))([a-zA-Z0-9._-]++/[a-zA-Z0-9._-]++)#(\d+)"
LOCAL = r"#(\d+)"
URL = rf"https?://github\.com/({REPO})/(?:issues|pull)/(\d+)"
SLACK = r"https?://([a-zA-Z0-9-]+)\.slack\.com/archives/([A-Z0-9]+)/p(\d+)"
JIRA = r"\b([A-Z][A-Z0-9]{1,9})-(\d+)\b"
LINK = r"\[([^\]]+)\]\((https?://[^)]+)\)"
NOT_JIRA = ["UTF-8", "SHA-256", "SHA-512", "ISO-8601", "HTTP-1", "HTTP-2", "TCP-IP", "BASE-64", "JSON-LD", "ECMA-262", "RFC-2119", "ES-2015", "ES-2020", "US-ASCII"]
REPO_TYPES = ["github-pr", "github-issue", "github-pr-comment"]

CANONICAL = ["references", "closes", "changes", "imports", "depends-on", "implements", "documents", "tests", "addresses", "discusses", "authored-by", "reviewed-by", "supersedes", "superseded-by"]
NORMAL = {
    "addresses": ["responds-to", "fixes", "solves", "mitigates", "fixes-bug", "resolves"],
    "discusses": ["about", "covers", "talks-about", "mentions", "describes"],
    "implements": ["adds-support-for", "realizes", "implements-feature"],
    "documents": ["doc-for", "explains", "describes-api", "summarizes"],
    "tests": ["verifies", "regression-test-for", "validates"],
    "references": ["cites", "links-to", "quotes", "related-to"],
    "depends-on": ["requires", "blocked-by"],
    "closes": ["closes-issue"],
    "imports": ["re-exports", "uses"],
    "authored-by": ["created-by", "written-by", "proposed-by", "published-by"],
}

STRONG = ["addresses", "implements", "changes", "closes", "tests"]
CONTEXT_ONLY = r"(?i)^Context:|^see\s+[#@]|^see\s+http|^flagged by|^related to|^fictional,?\s+see|^mentioned in|^cf\.\s"
INCOMPATIBLE = {"addresses": ["organization", "person", "event"], "changes": ["pr", "organization", "person", "concept"], "implements": ["organization", "person"], "closes": ["organization", "person", "concept"]}
CUES = {
    "addresses": r"(?i)\bfix|\bresolv|\baddress|\bhandl|\bmitigat|\bwork(?:ing)?\s+(?:on|for)\b|\btackl|\bsolv",
    "changes": r"(?i)\bchang|\bupdat|\bmodif|\brenam|\bremov|\badd(?:ed|s|ing)?\s+support|\brefactor|\bmigrat",
    "implements": r"(?i)\bimplement|\bread?liz|\bbuild|\bcreate[sd]?\b|\badd(?:ed|s|ing)?\b",
    "closes": r"(?i)\bclose[sd]?\b|\bfix(?:e[sd])?\b|\bresolve[sd]?\b",
    "tests": r"(?i)\btest|\bverif|\bvalidat|\bcheck|\bassert",
}
STATUS = r"(?i)\bmerge[sd]?\b|\blanded\b|\bsoon will\b|\bpending\b|\bblocked\b|\bwill be\b|\bup until\b"
PLACEHOLDER = r"(?i)^LINK_TO_|^TODO|^TBD$|^PLACEHOLDER|^INSERT_|^EXAMPLE_|^\[.*\]$|^#$|^owner/repo(/.*)?$"
PROPOSAL = r"(?i)\bshould\b|\bmakes sense to\b|\bbelongs in\b|\bwe need to\b|\bplan to\b|\bwould be good to\b|\bconsider\b.*\badding\b|\bI think\b.*\bshould\b"
UNCERTAIN = r"(?i)\bmaybe\b|\bprobably\b|\blikely\b|\bsoon will\b|\bmight\b|\bpossibly\b"
SUFFIXES = ["ization", "isation", "tion", "sion", "ment", "ness", "ible", "able", "ance", "ence", "ize", "ise", "ing", "ity", "ous", "est", "al", "ly", "er", "ed"]
DOUBLED = ["bb", "cc", "dd", "ff", "gg", "ll", "mm", "nn", "pp", "rr", "ss", "tt", "zz"]
MIN_RESOLVED_SHARE = 2 / 3


def all_matches(text: Column, pattern: str, *groups: int) -> Column:
    """An array of structs g0 (the whole match) and one field for each group, in text order."""
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, *groups)]
    return F.arrays_zip(*(p.alias(f"g{g}") for p, g in zip(parts, (0, *groups), strict=True)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, though ``use`` has it within lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _mode(repos: Column) -> Column:
    """The commonest element of an array, the first seen on ties; null for an empty one."""

    def of(own: Column) -> Column:
        counted = F.transform(F.array_distinct(own), lambda r, i: F.struct(F.size(F.filter(own, lambda x: x == r)).alias("n"), (-i).alias("i"), r.alias("r")))
        return F.array_max(counted)["r"]

    return _bound(repos, of)


def mentioned_repos(text: Column) -> Column:
    """Repositories in URLs, then in owner/name#n references, in text order."""
    return F.concat(F.regexp_extract_all(text, F.lit(URL), F.lit(1)), F.regexp_extract_all(text, F.lit(CROSS), F.lit(1)))


def batch_affinity(chunks: DataFrame) -> DataFrame:
    """One row: the repository that the batch mentions most (ties: the first in chunk order), or no row.

    Mentions are counted map-side; only distinct repositories are shuffled.
    """
    named = F.when(F.col("source_type").isin(REPO_TYPES), F.regexp_extract("source", rf"^({REPO})#\d+(?:/comment/\w+)?$", 1))
    own = F.when(F.length(named) > 0, F.array(named)).otherwise(F.array().cast("array<string>"))
    rows = chunks.select("id", F.posexplode(F.concat(own, mentioned_repos(F.col("content")))).alias("i", "repo"))
    counts = rows.groupBy("repo").agg(F.count("*").alias("n"), F.min(F.struct("id", "i")).alias("first"))
    return counts.orderBy(F.col("n").desc(), "first").limit(1).select(F.col("repo").alias("batch_repo"))


def regex_edges(chunks: DataFrame) -> DataFrame:
    """closes and references edges of chunks (id, content, source_type, source).

    A bare #n takes the repository of its chunk's source; else, at confidence
    0.5, the one its content names most, else the batch's; else it stays bare.
    """
    c = F.col("content")
    explicit = F.when(F.col("source_type").isin(REPO_TYPES), F.nullif(F.regexp_extract("source", rf"^({REPO})#\d+(?:/comment/\w+)?$", 1), F.lit("")))
    rows = chunks.select("id", "content", explicit.alias("explicit"), _mode(mentioned_repos(c)).alias("own")).join(F.broadcast(batch_affinity(chunks)), how="left")
    rows = rows.withColumn("repo", F.coalesce("explicit", "own", "batch_repo")).withColumn("sure", F.col("explicit").isNotNull())
    # A reference that follows its repository is not local: blank those out, keeping the rest.
    bare = F.regexp_replace(c, CROSS, " ")
    scoped = lambda n: F.when(F.col("repo").isNull(), F.concat(F.lit("#"), n)).otherwise(F.concat(F.col("repo"), F.lit("#"), n))
    sureness = F.when(F.col("sure") | F.col("repo").isNull(), 1.0).otherwise(0.5)

    def closing(m: Column) -> Column:
        full = F.length(m["g1"]) > 0
        target = F.when(full, F.concat(m["g1"], F.lit("#"), m["g2"])).otherwise(scoped(m["g3"]))
        return F.struct(F.lit("closes").alias("type"), target.alias("target_id"), m["g0"].alias("evidence"), F.when(full, 1.0).otherwise(sureness).alias("confidence"))

    def reference(target: Column, evidence: Column, confidence: Column) -> Column:
        return F.struct(F.lit("references").alias("type"), target.alias("target_id"), evidence.alias("evidence"), confidence.alias("confidence"))

    rows = rows.withColumn("closing", F.transform(all_matches(c, CLOSES, 1, 2, 3), closing))
    refs = F.concat(
        F.transform(F.regexp_extract_all(c, F.lit(CROSS), F.lit(0)), lambda m: reference(m, m, F.lit(1.0))),
        F.transform(F.regexp_extract_all(bare, F.lit(LOCAL), F.lit(1)), lambda n: reference(scoped(n), F.concat(F.lit("#"), n), sureness)),
    )
    refs = _bound(F.transform("closing", lambda x: x["target_id"]), lambda closed: F.filter(refs, lambda r: ~F.array_contains(closed, r["target_id"])))
    urls = F.transform(all_matches(c, URL, 1, 2), lambda m: reference(F.concat(m["g1"], F.lit("#"), m["g2"]), m["g0"], F.lit(1.0)))
    every = rows.select("id", F.posexplode(F.concat("closing", refs, urls)).alias("seq", "e"))
    return every.select("seq", "e.type", F.col("id").alias("source_id"), F.lit("issue").alias("target_type"), "e.target_id", "e.evidence", "e.confidence")


def heuristic_edges(chunks: DataFrame) -> DataFrame:
    """Slack permalinks, issue-tracker keys and Markdown links outside the code host, each target once a chunk (permalinks each time)."""
    c = F.col("content")
    out = lambda kind, target, evidence, sure: F.struct(F.lit(kind).alias("target_type"), target.alias("target_id"), evidence.alias("evidence"), F.lit(sure).alias("confidence"))
    slack = F.transform(all_matches(c, SLACK, 1, 2, 3), lambda m: out("slack-message", F.concat(m["g1"], F.lit("/"), m["g2"], F.lit("/p"), m["g3"]), m["g0"], 0.85))
    keys = F.array_except(F.regexp_extract_all(c, F.lit(JIRA), F.lit(0)), F.array(*map(F.lit, NOT_JIRA)))
    jira = F.transform(keys, lambda k: out("jira-ticket", k, k, 0.85))
    found = all_matches(c, LINK, 1, 2)
    first = F.filter(found, lambda m, i: ~F.exists(F.slice(found, 1, i), lambda x: x["g2"] == m["g2"]) & ~F.contains(m["g2"], F.lit("github.com")))
    links = F.transform(first, lambda m: out("url", m["g2"], m["g0"], 0.8))
    every = chunks.select("id", F.posexplode(F.concat(slack, jira, links)).alias("seq", "e"))
    return every.select("seq", F.lit("references").alias("type"), F.col("id").alias("source_id"), "e.*")


def changed_file_edges(files: DataFrame) -> DataFrame:
    """changes edges from (chunk_id, repo, path, sha)."""
    return files.select(
        F.lit("changes").alias("type"), F.col("chunk_id").alias("source_id"), F.lit("file").alias("target_type"),
        F.concat("repo", F.lit(":"), "path", F.lit("@"), "sha").alias("target_id"), F.concat(F.lit("Changed file: "), "path").alias("evidence"), F.lit(1.0).alias("confidence"),
    )


def import_edges(files: DataFrame) -> DataFrame:
    """imports edges from source files (id, path, content) by one pattern a language."""
    c = F.col("content")
    patterns = {
        r"\.(ts|tsx|js|jsx|mjs|cjs)$": r"""(?m)(?:import\s+(?:[^'"]*?\s+from\s+)?|export\s+[^'"]*?\s+from\s+|require\(\s*|import\(\s*)['"]([^'"]+)['"]""",
        r"\.py$": r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
        r"\.go$": r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"]+)"\s*$""",
        r"\.sol$": r"""(?m)^\s*import\s+(?:[^"']*from\s+)?["']([^"']+)["']""",
        r"\.rs$": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)",
    }
    none = F.array().cast("array<string>")
    found = none
    for ending, pattern in patterns.items():
        if r"import\s+([\w.]+)" in pattern:
            matched = F.transform(all_matches(c, pattern, 1, 2), lambda m: F.coalesce(F.nullif(m["g1"], F.lit("")), m["g2"]))
        else:
            matched = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
        found = F.when(F.col("path").rlike(ending), matched).otherwise(found)
    rows = files.select("id", F.explode(F.array_distinct(found)).alias("target_id"))
    kind = F.when(F.col("target_id").startswith("."), "file").otherwise("package")
    return rows.select(F.lit("imports").alias("type"), F.col("id").alias("source_id"), kind.alias("target_type"), "target_id", F.concat(F.lit("import "), "target_id").alias("evidence"), F.lit(0.95).alias("confidence"))


def dependency_edges(manifests: DataFrame) -> DataFrame:
    """depends-on edges from package.json, requirements.txt and go.mod (id, path, content)."""
    c = F.col("content")
    none = F.array().cast("array<string>")
    maps = [F.coalesce(F.map_keys(F.from_json(F.get_json_object(c, f"$.{k}"), "map<string,string>")), none) for k in ("dependencies", "devDependencies", "peerDependencies")]
    python = F.regexp_extract_all(c, F.lit(r"(?m)^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:[=<>!~\[;].*)?$"), F.lit(1))
    go = F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/[\w./-]+)\s+v[\w.+-]+"), F.lit(1))
    p = F.col("path")
    found = F.when(p.endswith("package.json"), F.concat(*maps)).when(p.rlike(r"requirements[^/]*\.txt$"), python).when(p.endswith("go.mod"), go).otherwise(none)
    rows = manifests.select("id", F.explode(F.array_distinct(found)).alias("target_id"))
    return rows.select(F.lit("depends-on").alias("type"), F.col("id").alias("source_id"), F.lit("package").alias("target_type"), "target_id", F.concat(F.lit("depends on "), "target_id").alias("evidence"), F.lit(1.0).alias("confidence"))


def resolved_import(target: Column, file: Column, repo: Column) -> Column:
    """A relative import below its file's folder in the repository (``/./`` is dropped, ``..`` stays); others as they are."""
    folder = F.regexp_replace(file, r"/?[^/]*$", "")
    return F.when(target.startswith("."), F.replace(F.concat_ws("/", repo, folder, target), F.lit("/./"), F.lit("/"))).otherwise(target)


def rejoined(pieces: DataFrame, most: int = 200) -> DataFrame:
    """(id, content): a document's pieces (id, chunk_index, content) in order, each without the longest start, of ``most`` characters at most, that the piece before ends with."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])

    def joined(done: Column, piece: Column) -> Column:
        size = F.least(F.char_length(done["last"]), F.char_length(piece), F.lit(most))
        sizes = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        shared = F.coalesce(F.array_max(F.filter(sizes, lambda n: F.endswith(done["last"], F.substring(piece, F.lit(1), n)))), F.lit(0))
        return F.struct(F.concat(done["text"], F.substring(piece, shared + 1, F.char_length(piece))).alias("text"), piece.alias("last"))

    start = F.struct(F.lit("").alias("text"), F.lit("").alias("last"))
    return pieces.groupBy("id").agg(F.aggregate(parts, start, joined, lambda x: x["text"]).alias("content"))


def composite_edges(parts: list[DataFrame], chunk_count: int) -> DataFrame:
    """Union of extractors' edges with provenance, merged, and at most 100 edges for each chunk in all."""
    return first_rows(checkpointed(merged(reduce(DataFrame.unionByName, parts))), 100 * chunk_count)


def first_rows(edges: DataFrame, most: int, ranges: int = 4096, size: int = 100_000) -> DataFrame:
    """The ``most`` first edges by ``seq`` (its first field is a whole number) without a global order.

    Equal spans of that number are counted, and the span that the limit cuts
    is divided and counted again until it holds at most ``size`` edges or one
    number. Edges before it stay; only within it are edges ranked. Edges of
    the same ``seq`` follow their other columns, whatever order tasks end in.
    """
    place = F.col("seq.ord")
    order = ["seq", *(c for c in edges.columns if c != "seq")]
    total, placed, low, high = edges.agg(F.count("*"), F.count(place), F.min(place).cast("long"), F.max(place).cast("long")).first()
    if total <= most:
        return edges
    if placed <= most:  # those without a number come last
        return edges.where(place.isNotNull()).unionByName(edges.where(place.isNull()).orderBy(*order).limit(most - placed))
    room = most
    while True:
        step = (high - low) // ranges + 1
        span = F.call_function("div", place.cast("long") - low, F.lit(step))  # in whole numbers: as doubles, far places would fall into the next span
        counts = edges.where(place.between(low, high)).groupBy(span.alias("span")).count().collect()  # ``ranges`` rows at most
        for number, n in sorted(tuple(r) for r in counts):
            if n > room:
                break
            room -= n
        low, high = low + number * step, min(low + (number + 1) * step - 1, high)
        if n <= size or low == high:
            break
    ranked = edges.where(place.between(low, high)).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).where(F.col("r") <= room)
    return edges.where(place < low).unionByName(ranked.drop("r"))


def normalized_type(c: Column) -> Column:
    """The canonical type of a free label; ``discusses`` for an unknown one."""
    out = F.when(c.isin(CANONICAL), c)
    for canonical, labels in NORMAL.items():
        out = out.when(c.isin(labels), F.lit(canonical))
    return out.otherwise(F.lit("discusses"))


def raw_llm_edges(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with all fields and a known source; confidence within 0.3..0.8, 0.5 if missing; canonical type."""
    full = edges.dropna(subset=[*KEY, "evidence"]).join(chunks.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    sure = F.least(F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(0.3)), F.lit(0.8))
    return full.withColumn("confidence", sure).withColumn("type", normalized_type(F.col("type")))


def merged(edges: DataFrame) -> DataFrame:
    """Edges of the same key become one: provenance and evidence united in order of ``seq``, the highest confidence plus 0.05 for each further extractor, 1 at most."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "extractor", "evidence")))
    sources = F.array_distinct(F.transform(F.col("rows"), lambda r: r["extractor"]))
    texts = F.array_distinct(F.filter(F.transform(F.col("rows"), lambda r: r["evidence"]), lambda t: t != ""))
    out = edges.groupBy(*KEY).agg(F.min("seq").alias("seq"), rows.alias("rows"), F.max("confidence").alias("confidence"))
    out = out.withColumn("provenance", sources).withColumn("evidence", F.array_join(texts, " | "))
    return out.withColumn("confidence", F.least(F.lit(1.0), F.col("confidence") + 0.05 * (F.size("provenance") - 1))).drop("rows")


def last_wins(edges: DataFrame) -> DataFrame:
    """Of each key the last edge, by ``seq`` and then by its other columns, at the place of the first."""
    w = Window.partitionBy(*KEY)
    ranked = edges.withColumn("_r", F.row_number().over(w.orderBy(*(F.col(c).desc() for c in ["seq", *(x for x in edges.columns if x not in [*KEY, "seq"])])))).withColumn("place", F.min("seq").over(w))
    return ranked.where("_r = 1").drop("_r")


def compacted(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges with a known source, the surest of each key (the first on ties)."""
    known = edges.join(chunks.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    best = F.max_by(F.struct(*edges.columns), F.struct("confidence", (-F.col("seq")).alias("s")))
    return known.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(best.alias("e")).select("e.*")


def bidirectional(edges: DataFrame) -> DataFrame:
    """Each edge forward and, with its ends swapped and its evidence marked, backward."""
    forward = edges.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), "type", "evidence", "confidence", F.lit("forward").alias("direction"))
    back = edges.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), "type", F.concat(F.lit("← "), "evidence").alias("evidence"), "confidence", F.lit("reverse").alias("direction"))
    return forward.unionByName(back)


def repo_source(c: Column) -> Column:
    """A source string without the code host's address, with or without its scheme (and then without .git), in lower case, without a leading ./"""
    bare = F.regexp_replace(c, r"(?i)^(?:https?://)?github\.com/", "")
    return F.regexp_replace(F.lower(F.when(bare != c, F.regexp_replace(bare, r"\.git$", "")).otherwise(bare)), r"^\./", "")


def holders(sources: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, norm): the distinct sources (norm) that contain each distinct probe, by an index of their runs of up to three characters.

    Only runs that some probe has are indexed, a probe meets the sources of
    its rarest run alone, and what meets is compared. The empty probe is in
    every source.
    """

    def runs(text: str, sizes: tuple[int, ...]) -> Column:
        n = F.char_length(text)
        of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(text), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(*(of(k) for k in sizes)))

    long = F.char_length("probe") >= 3
    needed = probes.where("probe <> ''").select("probe", F.explode(F.when(long, runs("probe", (3,))).otherwise(F.array("probe"))).alias("run"))
    wanted = checkpointed(needed.select("run").distinct())
    index = sources.select("norm", F.explode(runs("norm", (1, 2, 3))).alias("run")).join(sized(wanted), "run", "left_semi")
    index = checkpointed(index)
    counts = index.groupBy("run").agg(F.count("*").alias("n"))
    rarest = needed.join(counts, "run", "left").groupBy("probe").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("x")).where("x.n > 0")
    met = rarest.select("probe", F.col("x.run").alias("run")).join(index, "run").where(F.contains("norm", "probe"))
    empty = probes.where("probe = ''").limit(1).crossJoin(sources.select("norm"))  # one row
    return met.select("probe", "norm").unionByName(empty)


def resolved(targets: DataFrame, chunks: DataFrame, cap: int = 10) -> DataFrame:
    """(target, tier, id): the chunks of the first tier that has any.

    Tiers: 1 the id; 2 the normalized source; 3 a source that contains the
    target if that has a slash or colon, then without its first two parts
    (the source that brings the count to ``cap`` is the last); 4 what follows
    the first slash of target and source alike, if both have one. Tier 3 runs
    on distinct sources and on targets that tiers 1 and 2 left.
    """
    t = targets.select("target").distinct()
    c = chunks.select("id", "ord", "source", repo_source(F.col("source")).alias("norm"))
    one = t.join(c, F.col("target") == F.col("id").cast("string")).select("target", F.lit(1).alias("tier"), "id", "ord")
    two = t.withColumn("norm", repo_source(F.col("target"))).join(c, "norm").select("target", F.lit(2).alias("tier"), "id", "ord")
    left = t.join(one.union(two).select("target").distinct(), "target", "left_anti")
    sources = checkpointed(c.groupBy("norm").agg(F.min("ord").alias("first"), F.count("*").alias("n")))
    parts = F.split(repo_source(F.col("target")), "/")
    probes = left.where(F.col("target").rlike("[/:]")).select("target", repo_source(F.col("target")).alias("probe"), F.lit(3).alias("tier"))
    short = left.where((F.size(parts) > 2) & F.col("target").contains("/")).select("target", F.array_join(F.slice(parts, 3, 1000), "/").alias("probe"), F.lit(4).alias("tier"))
    probes = checkpointed(probes.unionByName(short))
    inside = probes.join(holders(sources, probes.select("probe").distinct()), "probe").join(sources, "norm")
    before = F.sum("n").over(Window.partitionBy("target", "tier").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    three = inside.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < cap).join(c, "norm").select("target", "tier", "id", "ord")
    name = F.when(F.col("norm").contains("/"), F.expr("substring(norm, instr(norm, '/') + 1)"))
    renamed = left.withColumn("norm", repo_source(F.col("target"))).withColumn("name", name).drop("norm")
    four = renamed.join(c.withColumn("name", name).drop("norm"), "name").select("target", F.lit(5).alias("tier"), "id", "ord")
    every = one.union(two).union(three).union(four)
    best = F.min("tier").over(Window.partitionBy("target"))
    return every.withColumn("best", best).where("tier = best").drop("best")


def edge_class(resolves: Column) -> Column:
    """bare, concept, package, url, resolved or unresolved, in that order."""
    t = F.col("target_type")
    return F.when(F.col("target_id").rlike(r"^#\d+$"), "bare").when(t.isin("concept", "package", "url"), t).when(resolves, "resolved").otherwise("unresolved")


def stem(w: Column) -> Column:
    """A lower-case word without the first of the suffixes whose removal leaves three letters; a doubled consonant before -ing or -ed is halved."""
    low = F.lower(w)
    out = None
    for s in SUFFIXES:
        root = F.substring(low, F.lit(1), F.length(low) - len(s))
        if s in ("ing", "ed"):
            root = F.when((F.length(root) >= 3) & F.substring(root, -2, 2).isin(DOUBLED), F.substring(root, F.lit(1), F.length(root) - 1)).otherwise(root)
        test = low.endswith(s) & (F.length(root) >= 3)
        out = F.when(test, root) if out is None else out.when(test, root)
    return out.otherwise(low)


def validated(edges: DataFrame) -> DataFrame:
    """Edges after the acceptance gates: ``type`` perhaps downgraded, ``reason`` null if accepted."""
    kind, target, text = F.col("type"), F.col("target_type"), F.col("evidence")
    down = kind.isin(STRONG) & text.rlike(CONTEXT_ONLY)
    for k, bad in INCOMPATIBLE.items():
        down = down | ((kind == k) & target.isin(bad))
    for k, cue in CUES.items():
        down = down | ((kind == k) & ~text.rlike(cue))
    down = down | ((kind == "discusses") & text.rlike(STATUS))
    rows = edges.withColumn("downgraded", F.coalesce(down, F.lit(False))).withColumn("type", F.when(F.col("downgraded"), "references").otherwise(kind))
    kind, goal = F.col("type"), F.col("target_id")
    stems = F.transform(F.filter(F.split(F.lower(F.replace(goal, F.lit("-"), F.lit(" "))), r"\s+"), lambda w: F.length(w) > 2), stem)
    heard = F.transform(F.split(F.lower(text), r"\s+"), stem)
    near = lambda s: F.exists(heard, lambda h: (h == s) | ((F.length(s) >= 3) & F.startswith(h, s)) | ((F.length(h) >= 3) & F.startswith(s, h)))
    grounded = F.size(F.filter(stems, near)) / F.size(stems)
    reason = (
        F.when(goal.rlike(PLACEHOLDER), "placeholder")
        .when(kind.isin("documents", "tests", "implements", "changes", "closes") & text.rlike(PROPOSAL), "proposal")
        .when(F.length(goal) < 3, "short id")
        .when((target == "file") & goal.rlike(r"^\.\.?/"), "relative path")
        .when(target.isin("file", "issue", "pr", "url", "document") & ~goal.rlike(r"[/.]|\d|^http"), "not resolvable")
        .when(F.length(F.trim(F.coalesce(text, F.lit("")))) < 10, "short evidence")
        .when((kind == "discusses") & (F.col("confidence") < 0.6), "low confidence")
        .when((target == "concept") & (F.size(stems) > 0) & (grounded < MIN_RESOLVED_SHARE), "not grounded")
        .when(kind.isin("implements", "changes", "closes", "tests") & text.rlike(UNCERTAIN), "uncertain")
    )
    return rows.withColumn("reason", reason)
