"""Incremental ingest: deduplication, catalog, cursors, segments, archives, revisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType
from pyspark.sql.window import Window

from ..llm.components import components
from ..session import checkpointed, importable, sized


def unseen(chunks: DataFrame, known_ids: DataFrame, known_fingerprints: DataFrame) -> DataFrame:
    """Chunks (id, fingerprint) whose id and fingerprint (else id) are not known; repeats within the batch stay, as each run knows only earlier ones.

    Ids and fingerprints meet what is known without the chunks, which then
    leave out those found: by broadcast after a count, beyond the limit by a shuffle.
    """
    marked = chunks.withColumn("_mark", F.coalesce(F.col("fingerprint"), F.col("id").cast("string")))
    keys = checkpointed(marked.select("id", "_mark").distinct())
    ids = checkpointed(keys.select("id").distinct().join(known_ids.select("id"), "id", "left_semi"))
    left = keys.join(ids, "id", "left_anti").select("_mark").distinct()
    marks = checkpointed(left.join(known_fingerprints.select(F.col("fingerprint").alias("_mark")), "_mark", "left_semi"))
    return marked.join(sized(ids), "id", "left_anti").join(sized(marks), "_mark", "left_anti").drop("_mark")


def document_filter(chunks: DataFrame, ids: list[str] | None = None, paths: list[str] | None = None, since: str | None = None) -> DataFrame:
    """By document id (chunks without one pass), by path or folder, by the coalesced timestamp."""
    out = chunks
    if ids:
        out = out.where(F.col("document_id").isNull() | F.col("document_id").isin(ids))
    if paths:
        test = F.lit(False)
        for p in paths:
            test = test | (F.col("path") == p) | F.col("path").startswith(p.rstrip("/") + "/")
        out = out.where(test)
    if since:
        out = out.where(F.try_to_timestamp(F.coalesce("ts", "updated_at")) >= F.lit(since).cast("timestamp"))
    return out


def excluded(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Chunks without those of archived documents and without superseded ones."""
    archived = catalog.where("state = 'archived'").select(F.explode("chunk_ids").alias("id"))
    old = catalog.select(F.explode("superseded_chunk_ids").alias("id"))
    return chunks.join(archived.union(old).distinct(), "id", "left_anti")


def catalog_upsert(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """The catalog after a batch: (document_id, version, chunk_ids, previous, superseded, state, mutability).

    incoming has document_id, version, chunk_ids, mutability and tombstone.
    New documents are added; append-only ones gain unseen chunks; the same
    version changes nothing; a new version supersedes the old one's chunks;
    a tombstone archives.
    """
    c = catalog.select("document_id", *(F.col(x).alias(f"c_{x}") for x in ("version", "chunk_ids", "previous", "superseded", "state", "mutability")))
    n = incoming.select("document_id", *(F.col(x).alias(f"n_{x}") for x in ("version", "chunk_ids", "mutability", "tombstone")))
    rows = c.join(n, "document_id", "full_outer")
    none = F.array().cast("array<string>")
    fresh, absent = F.col("c_version").isNull(), F.col("n_mutability").isNull()
    gone = F.coalesce("n_tombstone", F.lit(False))
    append = F.col("n_mutability") == "append-only"
    same = F.col("c_version") == F.col("n_version")
    keep = absent | gone | (same & ~append)
    return rows.select(
        "document_id",
        F.when(fresh, F.col("n_version")).when(keep, F.col("c_version")).otherwise(F.col("n_version")).alias("version"),
        F.when(fresh, F.col("n_chunk_ids")).when(keep, F.col("c_chunk_ids")).when(append, F.array_union("c_chunk_ids", "n_chunk_ids")).otherwise(F.col("n_chunk_ids")).alias("chunk_ids"),
        F.when(fresh, none).when(keep | append | same, F.col("c_previous")).otherwise(F.concat("c_previous", F.array("c_version"))).alias("previous"),
        F.when(fresh, none).when(keep | append, F.col("c_superseded")).otherwise(F.array_union("c_superseded", F.array_except("c_chunk_ids", "n_chunk_ids"))).alias("superseded"),
        F.when(gone, "archived").when(absent, F.col("c_state")).otherwise("active").alias("state"),
        F.coalesce("c_mutability", "n_mutability").alias("mutability"),
    )


def cursor(partial: Column, commit: Column, newest: Column, current: Column) -> Column:
    """Null after a partial run; a repository's commit; else the newest time, never earlier than the current one."""
    return F.when(partial, F.lit(None)).when(commit.isNotNull(), commit).otherwise(F.greatest(newest, current))


def segment_summary(chunks: DataFrame) -> DataFrame:
    """For each segment: its time range as given (by parseable time), source types, repositories and size."""
    ts = F.try_to_timestamp("ts_raw")
    repo = F.coalesce("repo", F.nullif(F.regexp_extract("source", r"^([a-zA-Z0-9._-]+/[a-zA-Z0-9._-]+)", 1), F.lit("")))
    rows = chunks.withColumn("_ts", ts).withColumn("_repo", repo)
    return rows.groupBy("segment_id").agg(
        F.min_by("ts_raw", "_ts").alias("from"), F.max_by("ts_raw", "_ts").alias("to"), F.array_sort(F.collect_set("source_type")).alias("source_types"), F.array_sort(F.collect_set("_repo")).alias("repos"), F.count("*").alias("chunks"),
    )


def revision_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(artifact_id, change) of two revisions (artifact_id, identity): a changed identity is one removal and one addition."""
    both = old.select("artifact_id", F.col("identity").alias("o")).join(new.select("artifact_id", F.col("identity").alias("n")), "artifact_id", "full_outer")
    change = F.when(F.col("o").isNull(), F.array(F.lit("added"))).when(F.col("n").isNull(), F.array(F.lit("removed"))).when(F.col("o") == F.col("n"), F.array(F.lit("unchanged"))).otherwise(F.array(F.lit("removed"), F.lit("added")))
    return both.select("artifact_id", F.explode(change).alias("change"))


def snapshot_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, from_path) of two file snapshots (path, hash): a removed and an added path of the same hash are a rename."""
    both = old.select("path", F.col("hash").alias("o")).join(new.select("path", F.col("hash").alias("n")), "path", "full_outer")
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified")
    rows = both.withColumn("change", kind).where("change is not null").withColumn("hash", F.coalesce("o", "n"))
    pick = Window.partitionBy("change", "hash").orderBy("path")
    rows = rows.withColumn("k", F.row_number().over(pick))
    gone = rows.where("change = 'deleted'").select("hash", "k", F.col("path").alias("from_path"))
    come = rows.where("change = 'added'").join(gone, ["hash", "k"], "left")
    moved = come.where("from_path is not null").select("from_path")
    out = come.select("path", F.when(F.col("from_path").isNotNull(), "renamed").otherwise("added").alias("change"), "from_path")
    rest = rows.where("change <> 'added'").join(moved, rows.path == moved.from_path, "left_anti").select("path", "change", F.lit(None).cast("string").alias("from_path"))
    return out.unionByName(rest)


def _lines(files: DataFrame) -> DataFrame:
    """(path, line, n, bytes): a file's distinct lines by hash, how often it has them and their bytes with the line end."""
    each = files.select("path", F.explode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("t"))
    return each.groupBy("path", F.md5("t").alias("line")).agg(F.count("*").alias("n"), (F.max(F.octet_length("t")) + 1).cast("long").alias("bytes"))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (from_path, path, likeness) in order those whose files no earlier pair took."""
    taken: tuple[set, set] = (set(), set())
    for batch in batches:
        kept = []
        for i, (a, b) in enumerate(zip(batch.column("from_path").to_pylist(), batch.column("path").to_pylist(), strict=True)):
            if a not in taken[0] and b not in taken[1]:
                taken[0].add(a)
                taken[1].add(b)
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))


def renames(gone: DataFrame, come: DataFrame, least: float = 0.5, most: int = 1 << 20) -> DataFrame:
    """(from_path, path, likeness): removed files (path, content) matched one to one with added ones.

    Likeness is the bytes of shared lines over the larger file's, ``least``
    or more. Pairs are taken from the most alike on, ties by the removed
    path, then by the added one. Only pairs that can be alike enough are
    compared: lines are ordered from the one that fewest added files have, and
    a pair must share one that is among the first of both files, as the rest
    of either alone is too little; nor may one file be too large for the other. Files that pairs connect, however far, lie in one
    task, which follows the order of their pairs; of more than ``most`` of
    them it follows the first, and the others wait without the files taken for
    another round. Files with equal contents are matched first, in order of
    their paths.
    """
    place = F.row_number().over(Window.partitionBy("h").orderBy("path"))
    named = lambda files: files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("h")).withColumn("k", place)
    same = checkpointed(named(gone).withColumnRenamed("path", "from_path").join(named(come), ["h", "k"]).select("from_path", "path"))
    gone = gone.join(same.select(F.col("from_path").alias("path")), "path", "left_anti")
    come = come.join(same.select("path"), "path", "left_anti")
    a, b = checkpointed(_lines(gone)), checkpointed(_lines(come))
    size = lambda d, name: d.groupBy("path").agg(F.sum(F.col("n") * F.col("bytes")).alias(name))
    lines = checkpointed(b.groupBy("line").agg(F.count("*").alias("holders")).join(a.select("line").distinct(), "line", "left_semi"))
    of_file = Window.partitionBy("path")
    rare_first = of_file.orderBy("holders", "line").rowsBetween(Window.unboundedPreceding, -1)

    def first(files: DataFrame) -> DataFrame:
        shared = files.join(lines, "line").join(size(files, "whole"), "path").withColumn("w", F.col("n") * F.col("bytes"))
        marked = shared.withColumn("spare", F.sum("w").over(of_file) - least * F.col("whole")).withColumn("before", F.coalesce(F.sum("w").over(rare_first), F.lit(0)))
        return marked.where(F.col("before") <= F.col("spare")).select("path", "line", "whole")

    like = F.least("x", "y") >= least * F.greatest("x", "y")
    met = first(a).select(F.col("path").alias("from_path"), "line", F.col("whole").alias("x")).join(first(b).withColumnRenamed("whole", "y"), "line").where(like).select("from_path", "path").distinct()
    common = met.join(a.select(F.col("path").alias("from_path"), "line", F.col("n").alias("m")), "from_path").join(b, ["path", "line"]).groupBy("from_path", "path").agg(F.sum(F.least("m", "n") * F.col("bytes")).alias("common"))
    sizes = common.join(size(a, "x").withColumnRenamed("path", "from_path"), "from_path").join(size(b, "y"), "path")
    pairs = checkpointed(sizes.select("from_path", "path", (F.col("common") / F.greatest("x", "y")).alias("likeness")).where(F.col("likeness") >= least))
    out = same.withColumn("likeness", F.lit(1.0))
    if pairs.isEmpty():
        return out
    importable(pairs.sparkSession)
    ends = pairs.withColumn("u", F.concat(F.lit("<"), "from_path")).withColumn("v", F.concat(F.lit(">"), "path"))
    pairs = checkpointed(ends.join(components(ends.select("u", "v")).withColumnRenamed("node", "u"), "u").select("from_path", "path", "likeness", "component"))
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.col("likeness").desc(), "from_path", "path"))
    while not pairs.isEmpty():
        first = pairs.repartition("component").withColumn("r", place).where(F.col("r") <= most)
        taken = checkpointed(first.select("from_path", "path", "likeness").mapInArrow(_walked, "from_path string, path string, likeness double"))
        out = out.unionByName(taken)
        pairs = checkpointed(pairs.join(taken.select("from_path"), "from_path", "left_anti").join(taken.select("path"), "path", "left_anti"))
    return out


def archived_once(archive: DataFrame, incoming: DataFrame) -> DataFrame:
    """Raw sources (document_id, version, content) that the archive lacks, with checksum and size, once each."""
    new = incoming.join(archive.select("document_id", "version"), ["document_id", "version"], "left_anti").dropDuplicates(["document_id", "version"])
    return new.select("document_id", "version", F.sha2("content", 256).alias("checksum"), F.octet_length("content").cast("long").alias("bytes"))


def index_gc(indexes: DataFrame, now: Column, ttl: float, cap: int) -> DataFrame:
    """Indexes (name, last_accessed, active) to drop: idle for longer than ``ttl``, then the least recent beyond ``cap``; never active ones."""
    aged = indexes.withColumn("idle", ~F.col("active") & (now - F.col("last_accessed") > ttl))
    order = Window.orderBy(F.col("active").desc(), F.col("last_accessed").desc(), "name")  # a catalog of indexes, not data
    kept = aged.where("not idle").withColumn("r", F.row_number().over(order))
    over = kept.where(~F.col("active") & (F.col("r") > cap)).select("name", F.lit("lru").alias("reason"))
    return aged.where("idle").select("name", F.lit("ttl").alias("reason")).unionByName(over)


def extraction_contexts(chunks: DataFrame, status: DataFrame, extractor: str) -> DataFrame:
    """Contexts (by source, else id) to process again: new, failed, pending, of another extractor, or with changed contents.

    A context's digest names its contents whatever their order: their number
    and the sums of the sixty-bit words of their sha256. Sums combine
    map-side, so a source with a third of all rows is no group anywhere.
    """
    words = [F.conv(F.substring(F.sha2("content", 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)") for k in range(4)]
    parts = chunks.groupBy(F.coalesce("source", "id").alias("context")).agg(F.count("content").alias("n"), *(F.sum(w).alias(f"w{k}") for k, w in enumerate(words)))
    contexts = parts.select("context", F.sha2(F.concat_ws(":", "n", *(f"w{k}" for k in range(4))), 256).alias("digest"))
    s = status.select("context", F.col("digest").alias("old"), "state", F.col("extractor").alias("by"))
    rows = contexts.join(s, "context", "left")
    stale = F.col("old").isNull() | (F.col("old") != F.col("digest")) | F.col("state").isin("failed", "pending") | (F.col("by") != extractor)
    return rows.where(F.coalesce(stale, F.lit(True))).select("context", "digest")


def shingled(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, source, x): the distinct 64-bit hashes of each document's runs of ``size`` words, from its words' hashes (docs: doc_id, source, words)."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            words = batch.column("words")
            lengths = words.value_lengths().to_numpy()
            v = words.flatten().to_numpy().view(np.uint64)
            n = max(len(v) - size + 1, 0)
            h = np.zeros(n, np.uint64)
            for k in range(size):
                h = h * factor + v[k : k + n]  # modulo 2 ** 64
            ends = np.cumsum(lengths)
            found = [np.unique(h[e - m : e - size + 1].view(np.int64)) if m >= size else h[:0].view(np.int64) for e, m in zip(ends, lengths, strict=True)]
            offsets = np.r_[0, np.cumsum([len(f) for f in found])].astype(np.int32)
            x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), x], names=["doc_id", "source", "x"])

    given = docs.select("doc_id", "source", "words")
    return given.mapInArrow(run, StructType([*given.schema.fields[:2]]).add("x", ArrayType(LongType())))


def _often(docs: DataFrame, share: float) -> DataFrame:
    """(source, x) that a ``share`` of the source's documents of any batch hold: all that hold it of the whole are among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("source").drop_null().unique():
                lists = batch.column("x").filter(pc.equal(batch.column("source"), source))
                x, n = np.unique(lists.flatten().to_numpy(), return_counts=True)
                x = x[n >= share * len(lists) - 1e-6]
                yield pa.RecordBatch.from_arrays([pa.array([source.as_py()] * len(x), pa.string()), pa.array(x, pa.int64())], names=["source", "x"])

    return docs.select("source", "x").mapInArrow(run, "source string, x long").distinct()


def common_shingles(docs: DataFrame, share: float, least: int = 2) -> DataFrame:
    """(doc_id, shingles, common): how many of a document's distinct shingles (docs: doc_id, source, x) are in ceil(share * n) or more of its source's n documents, in ``least`` at least.

    What reaches the share of the whole reaches it in one of the batches that
    tasks read, so only shingles that do are counted: they meet the documents
    by broadcast after a count; beyond the limit by a shuffle in which AQE
    splits the common keys.
    """
    importable(docs.sparkSession)
    docs = checkpointed(docs)
    total = docs.groupBy("source").agg(F.count("*").alias("total"))
    held = docs.select("doc_id", "source", F.explode("x").alias("x")).join(sized(checkpointed(_often(docs, share))), ["source", "x"], "left_semi")
    held = checkpointed(held)
    counts = held.groupBy("source", "x").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    common = checkpointed(counts.join(sized(total), "source").where(F.col("c") >= F.ceil(share * F.col("total"))).select("source", "x"))
    hits = held.join(sized(common), ["source", "x"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("common"))
    return docs.select("doc_id", F.size("x").cast("long").alias("shingles")).join(hits, "doc_id", "left").withColumn("common", F.coalesce("common", F.lit(0)))


def placed_overlays(overlay: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Overlay edges merged (last wins) into the segment that owns their source; an orphan's segment is null."""
    owner = chunks.select(F.col("id").alias("source_id"), "segment_id")
    every = edges.withColumn("_new", F.lit(0)).unionByName(overlay.withColumn("_new", F.lit(1)))
    last = Window.partitionBy("type", "source_id", "target_type", "target_id").orderBy(F.col("_new").desc(), F.col("seq").desc())
    return every.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r").join(owner, "source_id", "left")


def stored_segment(chunks: DataFrame) -> DataFrame:
    """Chunks as stored: chunker facts join the metadata (chunk metadata wins), empty signal scores become null."""
    facts = F.map_filter(F.create_map(F.lit("_chunkerName"), "chunker_name", F.lit("_chunkerVersion"), "chunker_version", F.lit("_chunkerSymbolPath"), "symbol_path"), lambda _, v: v.isNotNull())
    own = F.map_filter(facts, lambda k, _: ~F.map_contains_key(F.coalesce("metadata", F.create_map().cast("map<string,string>")), k))
    return chunks.withColumn("metadata", F.map_concat(own, F.coalesce("metadata", F.create_map().cast("map<string,string>")))).withColumn("signal_scores", F.when(F.size("signal_scores") > 0, F.col("signal_scores"))).withColumn("storage_id", F.col("id"))
