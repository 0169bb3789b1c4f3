"""The registered queries opN_* and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, brown, chat, decontam, html, lines, neardup, orderminhash, pieces, quality, resample, suffixarray, toxicity
from .common import remainder, table


#: The public vocabulary that the queries encode with; the operator takes any path.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), pieces.Pieces.load(TOKENIZER))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op5_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder("doc_id", 10) == 0
    out = brown.score(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixarray.removed(table(spark, sf_dir, "documents"), length=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.fingerprints(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), alignment.Vocabularies.load(BYTE_TOKENIZER, TOKENIZER))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express."""
    out = op5_brown_lm(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express."""
    return op10_order_minhash(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontamination": op3_decontamination,
    "op4_near_dedup": op4_near_dedup,
    "op5_brown_lm": op5_brown_lm,
    "op6_html_extraction": op6_html_extraction,
    "op7_chat_format": op7_chat_format,
    "op8_quality": op8_quality,
    "op9_suffix_array": op9_suffix_array,
    "op10_order_minhash": op10_order_minhash,
    "op11_token_alignment": op11_token_alignment,
    "op12_line_dedup": op12_line_dedup,
    "op13_importance_resampling": op13_importance_resampling,
    "lm_base_scores": lm_base_scores,
    "edited_texts": edited_texts,
}

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS length, array_to_string(list_slice(w, i, i + 9), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
places AS (
  SELECT doc_id, w, l.length, unnest(range(1, greatest(len(w) - l.length + 1, 0) + 1)) AS i
  FROM d, (SELECT DISTINCT length FROM win) l
),
hit AS (
  SELECT p.doc_id, p.i, p.length, win.item_id
  FROM (SELECT doc_id, i, length, array_to_string(list_slice(w, i, i + length - 1), ' ') AS phrase FROM places) p
  JOIN win ON win.length = p.length AND win.phrase = p.phrase
),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + length)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
"""

OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS g FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON p.u = r.v),
least_of AS (SELECT u, min(v) AS c FROM reach GROUP BY u)
SELECT d.doc_id, CAST(coalesce(len(s.g), 0) AS BIGINT) AS n_shingles, l.c AS component_id, d.doc_id = l.c AS kept
FROM d JOIN least_of l ON l.u = d.doc_id LEFT JOIN s ON s.doc_id = d.doc_id
"""

OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, o, substr(h, 2 * o + 1, 498) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 200)) AS o FROM d WHERE len(h) >= 100)),
w AS (SELECT doc_id, o + i AS i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, o, h, unnest(range(0, least(len(h) // 2 - 49, 200))) AS i FROM k)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, w.i FROM w JOIN m ON m.s = w.s WHERE m.least < w.doc_id),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, k),
piece AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
kept AS (SELECT d.doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS s, sum(b - a) AS gone, count(*) AS n, max(b) AS last FROM piece JOIN d ON d.doc_id = piece.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE concat(s, substr(h, 2 * last + 1)) END)) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

#: crc32 of a doc_id's digits, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [1000 + ord(c), 0, 0, 0, 0, 0, 0, 0, 0]))),
  lambda s, x: CASE WHEN x > 0 THEN xor(s, x - 1000) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295::BIGINT)"""

BASE_SQL = rf"""
WITH d AS (SELECT doc_id, {_CRC} % 10 = 0 AS held_out, list_append(regexp_extract_all(coalesce({_FOLD}, ''), '[^\x20\x09-\x0D]+'), NULL) AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS t FROM d),
c AS (SELECT t, count(*) AS c FROM t WHERE NOT held_out GROUP BY t), s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT t.doc_id, any_value(t.held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(s.n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.1) / (s.n + 0.1 * (s.v + 1)))), 4) AS base_score
FROM t LEFT JOIN c ON c.t IS NOT DISTINCT FROM t.t, s GROUP BY t.doc_id
"""

EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first(text) OVER (ORDER BY doc_id DESC)) AS next FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(concat(substr(text, 1, n - n // 3), substr(next, 1, n // 3))) AS edited_sha256 FROM o
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT doc_id, i, l[i] AS line, translate(trim(l[i], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
c AS (SELECT k, max(doc_id) AS lead FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id <> c.lead AS gone FROM l LEFT JOIN c ON c.k = l.k)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

OP13_SQL = rf"""
WITH texts AS (SELECT 'd' AS side, doc_id AS id, coalesce(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
  UNION ALL SELECT 'b', item_id, coalesce(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) FROM benchmark),
f AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS f FROM texts),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, len(x) // 2), lambda i: [1000 + CAST(concat('0x', substr(x, 2 * i + 1, 2)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0]))),
  lambda s, y: CASE WHEN y > 0 THEN xor(s, y - 1000) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295::BIGINT) % 10000 AS b FROM h),
n AS (SELECT b, count_if(side = 'd') AS s, count_if(side = 'b') AS t FROM f JOIN b USING (f) GROUP BY b),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM n),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST(n.t + 1 AS DOUBLE) * CAST(total.s + 10000 AS DOUBLE) / (CAST(n.s + 1 AS DOUBLE) * CAST(total.t + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM n, total),
w AS (SELECT id AS doc_id, count(*) AS n_features, CAST(sum(g) AS BIGINT) AS g FROM f JOIN b USING (f) JOIN gain USING (b) WHERE side = 'd' GROUP BY id),
d AS (SELECT id AS doc_id, len(texts.w) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN g IS NULL THEN 0 WHEN g % n_features < 0 THEN g // n_features - 1 ELSE g // n_features END AS weight,
  CAST(concat('0x', substr(sha256(concat('7:', CAST(id AS VARCHAR))), 1, 8)) AS BIGINT) AS h
  FROM texts LEFT JOIN w ON w.doc_id = id WHERE side = 'd'),
s AS (SELECT doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d),
r AS (SELECT *, n_words >= 20 AS able, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count_if(n_words >= 20) OVER () AS able_docs FROM s)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CAST(CASE WHEN able AND place <= (25 * able_docs) // 100 THEN place END AS BIGINT) AS rank
FROM r
"""

ORACLE_SQL: dict[str, str] = {"op12_line_dedup": OP12_SQL, "op13_importance_resampling": OP13_SQL, "op3_decontamination": OP3_SQL, "op4_near_dedup": OP4_SQL, "op9_suffix_array": OP9_SQL, "lm_base_scores": BASE_SQL, "edited_texts": EDITED_SQL}
