"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct word shingles (64-bit hashes). Equal sets
become one node first, so exact copies never meet in pairs. A sketch has 384
bins: in rounds 1..384 each shingle is thrown into a random bin, in rounds
385..768 into bin number round-384, so that every bin fills; rounds end as
soon as a text's bins are full. 64 bands of six bins give the buckets: a pair
of similarity 0.8 shares none with a probability of 4e-9, and one of 0.3
shares one with 5 %.

Links are confirmed on whole sets. A small bucket tests all its pairs. A
larger one tests its members against a pivot, the densest (the member that
shares most buckets, as the common origin of edited copies does). Members of
buckets that still hold several components are compared with each other by
prefix filter: a set's shingles are ordered from the rarest, and two sets that
are similar enough share one of their first few. What differs from the pivot
is rare, so a family around one origin meets on few keys. No link is lost
after the banding, no set is sent more than once for each pair, and a key with
many rows is dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed, heavy, heavy_of, mapped, sized, spread
from .components import components

BINS, ROWS = 384, 6
#: Buckets of up to this many sets test all pairs: at most 1.5 pairs for each member.
SMALL = 4
#: Sizes within this ratio share a class in the prefix filter.
RATIO = 1.05


def sketch(doc: np.ndarray, hashes: np.ndarray, n_docs: int, bins: int = BINS) -> np.ndarray:
    """An n_docs x bins array of bin minima; a text without shingles keeps the largest value."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((n_docs, bins), empty, np.uint64)
    flat, open_ = out.reshape(-1), np.unique(doc)
    for r, seed in enumerate(K.seeds(2 * bins, 1001)):
        if not len(open_):
            break
        x = K.mix(hashes ^ seed)
        place = ((x >> np.uint64(32)) % np.uint64(bins)).astype(np.int64) if r < bins else r - bins
        np.minimum.at(flat, doc * bins + place, (np.uint64(r) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)))
        full = (out[open_] != empty).all(1)
        if full.any():
            live = np.zeros(n_docs, bool)
            open_ = open_[~full]
            live[open_] = True
            live = live[doc]
            doc, hashes = doc[live], hashes[live]
    return out


def bands(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of the key."""
    n, bins = sketches.shape
    count = bins // rows
    seeds = K.seeds(count, 5001)
    out = np.zeros((n, count), np.uint64)
    for r in range(rows):
        out = K.mix((out + sketches[:, r::rows][:, :count]) ^ (seeds + np.uint64(r)))
    return out


def _shingled(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in K.slices(column, rows=4000):
        starts, ends, doc = K.words(data, offsets, K.SPACE)
        yield i, j, *K.shingles(K.Text(data).ranges(starts, ends), doc, k, j - i)


def _names(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The size and the 128-bit name of each text's set."""
    size = np.bincount(doc, minlength=n)
    first = np.r_[0, np.cumsum(size)[:-1]]
    sums = []
    for seed in K.seeds(2, 9001):
        total = np.r_[np.uint64(0), np.cumsum(K.mix(h ^ seed))]
        sums.append((total[first + size] - total[first]).view(np.int64))
    return size, sums


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, doc, h in _shingled(batch.column("text"), k):
                n = j - i
                size, sums = _names(doc, h, n)
                keys = bands(sketch(doc, h, n)).view(np.int64)
                offsets = np.r_[0, np.cumsum(np.where(size > 0, keys.shape[1], 0))].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[size > 0].ravel()))
                given = [batch.column(c).slice(i, n) for c in ("doc_id", "th")]
                yield pa.RecordBatch.from_arrays([*given, pa.array(size), pa.array(sums[0]), pa.array(sums[1]), lists], names=["doc_id", "th", *NAME, "bands"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, doc, h in _shingled(batch.column("text"), k):
                size, sums = _names(doc, h, j - i)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(sums[0]), pa.array(sums[1]), lists], names=[*NAME, "shingles"])

    return run


#: A set's name: its size and two sums of its hashes.
NAME = ("n_shingles", "s1", "s2")
_NAME = "n_shingles long, s1 long, s2 long"


def signatures(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles, s1, s2 (a 128-bit name of the set) and bands of each row."""
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return mapped(rows, _signatures(k), f"doc_id long, th long, {_NAME}, bands array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets have 100 * intersection >= percent * union; a v of many pairs is dealt out."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = spread(pairs.join(a, "u"), b, ["v"], heavy(pairs, ["v"]), "u")
    both = both.withColumn("common", F.size(F.array_intersect("a", "b")))
    return both.where(100 * F.col("common") >= percent * (F.size("a") + F.size("b") - F.col("common"))).select("u", "v")


def _prefix_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of ``rest`` (node, component) that may be similar enough, in unlike components.

    Shingles are ordered by how many sets of ``rest`` hold them. If the first
    that sets of sizes a and b share has place p (from 0) in the one, they
    share a - p at most, so (a - p) * (100 + percent) >= percent * (a + b)
    must hold, and likewise in the other: an entry names the sizes that its
    place allows, by classes, and entries meet on (shingle, both classes).
    """
    lists = checkpointed(rest.join(sets, "node"))
    each = lists.select("node", F.explode("shingles").alias("s"))
    counts = checkpointed(each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"))
    common = spread(each, counts, ["s"], heavy_of(counts, "n", ["s"]), "node")
    ordered = common.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("common"))
    ordered = lists.select("node", "component", F.size("shingles").cast("long").alias("a")).join(ordered, "node")
    entries = ordered.select("node", "component", "a", F.size("common").alias("held"), F.posexplode("common").alias("at", "x"))
    place = F.col("a") - F.col("held") + F.col("at")
    high = F.floor((F.col("a") - place) * (100 + percent) / percent) - F.col("a")
    entries = entries.select("node", "component", "a", F.col("x.s").alias("s"), F.ceil(F.col("a") * percent / 100).alias("low"), F.least(high, F.floor(F.col("a") * 100 / percent)).alias("high"))
    kind = lambda c: F.floor(F.log(c) / float(np.log(RATIO))).cast("int")
    entries = entries.where("high >= low").withColumn("own", kind(F.col("a"))).withColumn("other", F.explode(F.sequence(kind(F.col("low")), kind(F.col("high")))))
    entries = checkpointed(entries.select("node", "component", "a", "low", "high", "s", "own", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2")))
    key = ["s", "c1", "c2"]
    right = entries.select(*key, *(F.col(c).alias(c + "_") for c in ("node", "component", "a", "low", "high", "own")))
    met = spread(entries, right, key, heavy(entries, key), "node")
    met = met.where("node > node_ and component != component_ and own + own_ = c1 + c2 and a_ between low and high and a between low_ and high_")
    return met.select(F.col("node").alias("u"), F.col("node_").alias("v")).distinct()


def _sets_of(nodes: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the given nodes (node, doc and the name), from the texts."""
    wanted = checkpointed(nodes)
    chosen = documents.select("doc_id", "text").join(sized(wanted.select("doc").distinct(), wanted.count()), F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi")
    found = mapped(chosen, _sets(k), f"{_NAME}, shingles array<long>")
    return checkpointed(found.join(wanted.drop("doc"), list(NAME)).select("node", "shingles").dropDuplicates(["node"]))


def links(nodes: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of every node that has a link; ``nodes`` has node, doc, the name and bands."""
    keyed = nodes.select("node", F.explode("bands").alias("band"))
    counts = checkpointed(keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    hot = heavy_of(counts, "n", ["band"])
    members = checkpointed(spread(keyed, counts, ["band"], hot, "node").select("band", "n", "node"))
    small = members.where(F.col("n") <= SMALL)
    other = small.select("band", F.col("node").alias("v"))
    pairs = small.select("band", F.col("node").alias("u")).join(other, "band").where("u > v").select("u", "v")
    density = members.groupBy("node").agg(F.sum("n").alias("density"))
    large = checkpointed(members.where(F.col("n") > SMALL).join(density, "node").select("band", "node", "density"))
    densest = large.groupBy("band").agg(F.max(F.struct("density", (-F.col("node")).alias("node"))).alias("x"))
    pivots = densest.select("band", (-F.col("x.node")).alias("v"))
    star = spread(large.select("band", F.col("node").alias("u")), pivots, ["band"], hot, "u").where("u != v").select("u", "v")

    sets = _sets_of(nodes.drop("bands").join(members.select("node").distinct(), "node", "left_semi"), documents, k)
    labels = checkpointed(components(_verified(checkpointed(pairs.union(star).distinct()), sets, percent)))
    now = checkpointed(large.select("band", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    split = now.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    rest = checkpointed(spread(now, split, ["band"], hot, "node").select("node", "component").distinct())
    if rest.isEmpty():
        return labels
    new = checkpointed(_verified(checkpointed(_prefix_pairs(rest, sets, percent)), sets, percent))
    return labels if new.isEmpty() else joined(labels, new)


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after further ``links`` (u, v): only the components that these touch are joined again."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    tops = checkpointed(components(between))
    moved = labels.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return checkpointed(moved.union(tops.join(labels, "node", "left_anti").select("node", "component")))


def _classes(rows: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """(the name, copies, component, least): for each distinct set of ``rows`` how many rows have it, its component and the component's smallest doc_id and, of that, text hash."""
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("doc"), "th"))).alias("least")
    found = rows.where("n_shingles > 0").groupBy(*NAME).agg(least, F.any_value("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = checkpointed(found.withColumn("node", F.monotonically_increasing_id()).withColumn("doc", F.col("least.doc")))
    labels = links(nodes.select("node", "doc", *NAME, "bands"), documents, k, percent)
    whole = checkpointed(nodes.select("node", *NAME, "copies", "least").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")))
    first = whole.groupBy("component").agg(F.min("least").alias("least"))
    return checkpointed(spread(whole.drop("least"), first, ["component"], heavy(whole, ["component"]), "node"))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``documents``.

    Documents are linked if their sets of k-word shingles have a Jaccard
    similarity of ``percent`` or more; the component is the smallest doc_id
    reachable. A text without words has no shingles and is linked with
    nothing. Rows with the same doc_id are linked by their texts like others,
    and each has its own component. A row with a null doc_id is linked as
    others are but names no component: its component_id is null only if no
    linked row has an id, and it is never kept.
    """
    rows = checkpointed(signatures(documents, k))
    classes = _classes(rows, documents, k, percent).select(*NAME, "copies", F.col("least.doc").alias("component"))
    out = spread(rows.select("doc_id", "th", *NAME), classes, list(NAME), heavy_of(classes, "copies", list(NAME)), "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest doc_id.

    Of several texts under that doc_id the one with the least hash stays, and
    of rows alike in doc_id and text the one whose other columns have the
    least hash. Texts without words and rows without doc_id all stay.
    """
    rows = checkpointed(signatures(documents, k))
    classes = _classes(rows, documents, k, percent).select(*NAME, "copies", "least")
    known = rows.where("n_shingles > 0 and doc_id is not null").select("doc_id", "th", *NAME)
    met = spread(known, classes, list(NAME), heavy_of(classes, "copies", list(NAME)), "doc_id")
    mine = F.struct(F.col("doc_id").alias("doc"), "th") == F.col("least")
    marks = met.groupBy("doc_id", "th").agg(F.bool_or(mine).alias("stays"), F.count("*").alias("n"))
    marks = checkpointed(marks.where("not stays or n > 1").select(F.struct("doc_id", "th").alias("key"), "stays"))
    whole = documents.select(F.struct("*").alias("row")).withColumn("own", F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("th")))
    out = whole.join(sized(marks, marks.count()), F.col("own") == F.col("key"), "left")
    repeated = out.where("stays").groupBy("own").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.where("stays is null").select("row.*").unionByName(repeated.select("row.*"))
