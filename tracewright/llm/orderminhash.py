"""Order MinHash fingerprints, in DataFrame functions only.

A text's tokens (runs of at most 24 characters without white space) make
k-mers of three tokens, each numbered by its occurrence. Numbered k-mers are
hashed to a circle of 2**40 points. At each of 64 evenly spaced points the
two next k-mers on the circle are taken, put in text order, and hashed as a
tuple: the share of equal tuples of two texts falls with their edit distance,
moved passages included. One pass over the k-mers serves all 64 points.

Defined cases: null is the empty text; texts without tokens share one
fingerprint; rows with a null doc_id come last in the order; repeated ids are
ordered by a hash of their text; the only document's next one is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions

TOKEN = r"[^\x20\x09-\x0D]{1,24}"
KMER, POINTS = 3, 64
_PLACE_BITS = 24
_PLACE = (1 << _PLACE_BITS) - 1


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _packed(h: Column, place: Column) -> Column:
    """The upper 40 bits of a hash over 24 bits of a place, as one sortable long."""
    return h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(place.bitwiseAND(F.lit(_PLACE)).cast("long"))


def _numbered(kmers: Column) -> Column:
    """Hashes of (k-mer, occurrence) over their places, sorted: equal k-mers are neighbours after a first sort."""

    def runs(p: Column) -> Column:
        hashed = lambda i: F.shiftright(F.get(p, i), _PLACE_BITS)
        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (hashed(i) != hashed(i - 1)))
        number = lambda x, o: _packed(F.xxhash64(F.shiftright(x, _PLACE_BITS), o), x)
        return let(starts, lambda s: F.flatten(F.transform(s, lambda a, r: F.transform(F.slice(p, a + 1, F.coalesce(F.get(s, r + 1), F.size(p)) - a), number))))

    return F.sort_array(let(F.sort_array(kmers), runs))


def _tuple(x: Column, y: Column) -> Column:
    """Eight hex digits for two numbered k-mers in text order."""
    h = lambda z: F.shiftright(z, _PLACE_BITS)
    place = lambda z: z.bitwiseAND(F.lit(_PLACE))
    digits = F.when(place(x) <= place(y), F.hash(h(x), h(y))).otherwise(F.hash(h(y), h(x)))
    return F.lpad(F.lower(F.hex(digits.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")


def _signature(sorted_kmers: Column) -> Column:
    """From each point of the circle, the first numbered k-mer at or after it and the one after that."""
    shift = 64 - POINTS.bit_length() + 1
    half = POINTS // 2

    def pick(q: Column) -> Column:
        n = F.size(q)
        arcs = F.transform(q, lambda z: F.shiftright(z, shift))
        at = lambda a: F.array(*(F.array_position(a, F.lit(j - half).cast("long")).cast("int") for j in range(POINTS)))
        # An arc without k-mers takes the start of the next arc that has any, around the circle.
        filled = lambda f: F.transform(f, lambda x, j: F.when(x > 0, x - 1).otherwise(F.coalesce(F.get(F.filter(F.slice(f, j + 1, POINTS), lambda z: z > 0), F.lit(0)) - 1, F.lit(0))))
        return let(let(arcs, at), lambda f: F.array_join(F.transform(filled(f), lambda i: _tuple(F.get(q, i), F.get(q, F.pmod(i + 1, n)))), ""))

    return let(sorted_kmers, pick)


def fingerprint(text: Column) -> Column:
    """64 tuples of eight hex digits; zeros for a text without tokens."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - KMER, F.lit(0)))
        kmers = F.transform(places, lambda i: _packed(F.xxhash64(*(F.get(w, i + k) for k in range(KMER))), i))
        return F.when(F.size(w) > 0, _signature(_numbered(kmers))).otherwise(F.lit("0" * 8 * POINTS))

    return let(tokens, of)


def likeness(a: Column, b: Column) -> Column:
    """The share of equal tuples of two fingerprints."""
    parts = F.sequence(F.lit(0), F.lit(POINTS - 1))
    same = F.filter(parts, lambda i: F.substring(a, i * 8 + 1, F.lit(8)) == F.substring(b, i * 8 + 1, F.lit(8)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.size(same) / F.lit(float(POINTS)))


def _bucket(doc_id: Column, bounds: list[list[int]]) -> Column:
    """The range of an id, by its place among coarse and then fine bounds; null ids share the first."""
    if not bounds:
        return F.lit(0)
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    coarse = longs([x[0] for x in bounds])
    fine = F.array(*(longs(x) for x in bounds))
    top = F.size(F.filter(coarse, lambda b: b < doc_id))
    low = F.size(F.filter(F.get(fine, F.greatest(top - 1, F.lit(0))), lambda b: b < doc_id))
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(F.greatest(top - 1, F.lit(0)) * len(bounds[0]) + low)


def with_next(documents: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text and next_text, in descending order of doc_id; after the last comes the first.

    Ids are cut into ranges at quantiles, a range is sorted in one task, and
    the first row of each range is copied into the range before it: one
    shuffle of the texts and no global order.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = buckets or min(4 * partitions(spark), 1_000_000)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    width = max(1, int(len(cuts) ** 0.5))
    bounds = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if bounds:
        bounds[-1] += [bounds[-1][-1]] * (width - len(bounds[-1]))
    dealt = rows.withColumn("b", _bucket(F.col("doc_id"), bounds))
    top = dealt.where("doc_id is not null").groupBy("b").agg(F.max("doc_id").alias("top"))
    some = dealt.where("doc_id is null").select("b").limit(1).withColumn("top", F.lit(None).cast("long"))
    heads = top.unionByName(some.join(top, "b", "left_anti"))  # one row for each range
    order = Window.orderBy(F.col("b"))
    before = F.coalesce(F.lead("b").over(order), F.first("b").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("top"), F.col("b").alias("own"), before.alias("into"))
    copies = dealt.join(F.broadcast(heads), (dealt.doc_id.eqNullSafe(heads.top)) & (dealt.b == heads.own))
    copies = copies.select("doc_id", "text", F.col("into").alias("b"), F.lit(1).alias("copy"))
    return dealt.select("doc_id", "text", "b", F.lit(0).alias("copy")).unionByName(copies)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text is the text with its last third replaced by as much of
    the start of the next document.
    """
    dealt = with_next(documents).withColumn("th", F.xxhash64("text"))
    order = Window.partitionBy("b").orderBy("copy", F.col("doc_id").desc_nulls_last(), "th")
    dealt = dealt.withColumn("next_text", F.lead("text").over(order))
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(char_length(text) / 3) as int))"))
    made = dealt.select(
        "doc_id", "b", "copy", "th", F.char_length("text").cast("long").alias("n_chars"),
        fingerprint(F.col("text")).alias("fingerprint"),
        F.when(F.col("copy") == 0, F.struct(F.sha2(F.coalesce(edited, "text").cast("binary"), 256).alias("sha"), fingerprint(edited).alias("fp"))).alias("e"),
    )
    made = made.withColumn("next_fp", F.lead("fingerprint").over(order)).where("copy = 0")
    return made.select(
        "doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), "fingerprint", F.col("e.fp").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("e.fp")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )
