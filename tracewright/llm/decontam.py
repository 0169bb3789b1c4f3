"""Benchmark decontamination by a positional inverted index, in DataFrame functions only.

Terms of the benchmark are counted over all training documents. Each window
of a benchmark item keeps its two rarest terms; postings (document, position)
are stored for those terms alone. Offset-adjusted lists are intersected from
the rarest term, and the survivors are compared word by word with the text.

Defined cases: a null text has no words and is never hit; a null doc_id is a
document of its own; repeated rows each get a result; an item without words,
without text or without id has no windows; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, checkpointed, sized

#: Words before folding: digits, ASCII letters and every character above ASCII.
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(c: Column) -> Column:
    """A-Z in lower case, nothing else changed; plain lower() where the text is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(phrase, length, item_id): each run of ``size`` consecutive words of an item, or all of a shorter one."""
    w = words(folded(F.col("text")))
    items = benchmark.where("item_id is not null and text is not null").select("item_id", w.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return (
        items.select("item_id", "w", F.explode(starts).alias("i"))
        .select("item_id", F.array_join(F.slice("w", F.col("i"), size), " ").alias("phrase"))
        .withColumn("length", F.size(F.split("phrase", " ")))
        .distinct()
    )


def postings(documents: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """(key, pos, term) of the given terms; ``documents`` has key and text. Positions count words from 0."""
    tokens = documents.select("key", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return tokens.select("key", "pos", folded(F.col("word")).alias("term")).join(sized(terms, n_terms), "term")


def matches(documents: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """(doc_id, text_hash, start, length, phrase): every occurrence of a benchmark window.

    With ``slop`` 0 an occurrence is the exact phrase. With more, it is a
    place where the two rarest terms lie at most ``slop`` words off their
    distance in the window and all the window's words lie within ``slop``
    words of it.
    """
    found = windows(benchmark, size)
    phrases = checkpointed(found.select("phrase", "length").distinct())
    term_list = phrases.select("phrase", "length", F.posexplode(F.split("phrase", " ")).alias("off", "term"))
    vocabulary = term_list.select("term").distinct()
    n_vocabulary = vocabulary.count()
    keyed = documents.where("text is not null").select(F.col("doc_id").alias("key"), "text")
    tokens = keyed.select(F.explode(words(F.col("text"))).alias("word")).select(folded(F.col("word")).alias("term"))
    frequency = tokens.join(sized(vocabulary, n_vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    frequency = checkpointed(frequency)

    # A window with a term that no document has can't occur; the others keep their two rarest places.
    rarest = Window.partitionBy("phrase").orderBy("n", "off")
    ranked = term_list.join(frequency, "term", "left").withColumn("rank", F.row_number().over(rarest)).groupBy("phrase", "length")
    place = lambda r: F.max(F.when(F.col("rank") == r, F.struct("term", "off")))
    plan = ranked.agg(place(1).alias("a"), F.coalesce(place(2), place(1)).alias("b"), F.count("n").alias("known"))
    plan = checkpointed(
        plan.where("known = length").select("phrase", "length", F.col("a.term").alias("term"), F.col("a.off").alias("off"), F.col("b.term").alias("term2"), F.col("b.off").alias("off2"))
    )
    n_plan = plan.count()
    chosen = plan.select("term").union(plan.select("term2")).distinct()
    index = checkpointed(postings(keyed, chosen, n_plan))

    first = index.join(sized(plan, n_plan, BROADCAST_ROWS // 4), "term").select("key", (F.col("pos") - F.col("off")).alias("start"), "phrase", "length", "term2", "off2").where("start >= 0")
    second = index.select(F.col("key").alias("key_b"), F.col("term").alias("term_b"), F.col("pos").alias("pos_b"))
    pair = F.col("key").eqNullSafe(F.col("key_b")) & (F.col("term2") == F.col("term_b"))
    if slop == 0:
        both = first.join(second, pair & (F.col("start") + F.col("off2") == F.col("pos_b")))
    else:
        both = first.join(second, pair & (F.abs(F.col("start") + F.col("off2") - F.col("pos_b")) <= slop))
    candidates = checkpointed(both.select("key", "start", "phrase", "length").distinct())

    holders = candidates.select(F.col("key").alias("holder")).distinct()
    n_holders = holders.count()
    texts = documents.where("text is not null").select("doc_id", "text")
    texts = texts.join(sized(holders, n_holders), F.col("doc_id").eqNullSafe(F.col("holder")), "left_semi")
    texts = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), words(folded(F.col("text"))).alias("w")).distinct()
    # A text meets all its candidates in one row, so its words are never copied.
    wanted = candidates.groupBy("key").agg(F.collect_list(F.struct("start", "length", "phrase")).alias("c"))
    placed = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("key")))

    def occurs(c: Column) -> Column:
        if slop == 0:
            return F.array_join(F.slice("w", c["start"] + 1, c["length"]), " ") == c["phrase"]
        low = F.greatest(c["start"] - slop, F.lit(0))
        return F.size(F.array_except(F.split(c["phrase"], " "), F.slice("w", low + 1, c["length"] + c["start"] + slop - low))) == 0

    return placed.select("doc_id", "text_hash", F.explode(F.filter("c", occurs)).alias("x")).select("doc_id", "text_hash", "x.start", "x.length", "x.phrase")


def decontaminate(documents: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 0) -> DataFrame:
    """One row for each row of ``documents``: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` counts the words inside any occurrence of a window; ``items``
    (an array of strings, sorted) are the items whose windows occur.
    """
    hits = checkpointed(matches(documents, benchmark, size, slop))
    covered = (
        hits.groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("start", "length")).alias("spans"))
        .select(
            F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"),
            F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))))).cast("long").alias("n_hit"),
        )
    )
    of_phrase = windows(benchmark, size).select("phrase", F.col("item_id").cast("string").alias("item"))
    n_windows = of_phrase.count()
    items = (
        hits.select("doc_id", "text_hash", "phrase").distinct()
        .join(sized(of_phrase, n_windows, BROADCAST_ROWS // 4), "phrase")
        .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumnsRenamed({"doc_id": "item_doc", "text_hash": "item_hash"})
    )
    found = covered.join(items, F.col("hit_id").eqNullSafe(F.col("item_doc")) & (F.col("hit_hash") == F.col("item_hash"))).select("hit_id", "hit_hash", "n_hit", "items")
    rows = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    joined = rows.join(found, rows.doc_id.eqNullSafe(F.col("hit_id")) & (rows.text_hash == F.col("hit_hash")), "left")
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "text_hash", "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_or_none).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_or_none, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        items_or_none.alias("items"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents that hold no window of the benchmark, with all their columns."""
    hits = matches(documents, benchmark, size).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    hits = checkpointed(hits)
    same = F.col("row.doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("row.text") == F.col("hit_hash"))
    return documents.select(F.struct("*").alias("row")).join(sized(hits, hits.count()), same, "left_anti").select("row.*")
