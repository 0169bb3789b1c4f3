"""Text queries over ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking
from ..operators import ingest as I
from ..registry import query, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_PHRASE = "concat(text, ' ', CASE doc_id % 8 WHEN 0 THEN 'it is broken and fails with a timeout error' WHEN 1 THEN 'love this, thank you, perfect' WHEN 2 THEN 'would be nice, please add it' WHEN 3 THEN 'I wrote a script as a workaround manually' WHEN 4 THEN 'how to find what is here' WHEN 5 THEN 'what do the docs say about it' WHEN 6 THEN 'how does the algorithm work' ELSE 'nothing' END)"
_WORDS = r"list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), '\]\([^)]*\)', ']', 'g'), 'https?://\S+', '', 'g'), '[^a-z0-9_]+'), lambda w: w <> '')"


@query(
    "shingle_boilerplate",
    rf"""WITH w AS (SELECT doc_id, {_WORDS} AS w, source FROM documents),
s AS (SELECT doc_id, source, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM w),
u AS (SELECT doc_id, source, unnest(s) AS x FROM s), n AS (SELECT source, x, count(*) AS c FROM u GROUP BY source, x), t AS (SELECT source, count(*) AS total FROM s GROUP BY source)
SELECT u.doc_id, count(*) AS shingles, CAST(count(*) FILTER (WHERE n.c >= greatest(ceil(0.02 * t.total), 2)) AS BIGINT) AS common FROM u JOIN n USING (source, x) JOIN t USING (source) GROUP BY u.doc_id""",
)
def shingle_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles that many documents of a source share."""
    docs = _docs(spark, sf_dir).select("doc_id", "source", X.word_hashes(F.col("text")).alias("words"))
    return I.common_shingles(I.shingled(docs), 0.02).where("shingles > 0")


@query("term_extract", r"SELECT doc_id, CAST(len(list_distinct(list_filter(string_split_regex(lower(text), '[\s\p{P}]+'), lambda w: length(w) > 2))) AS INTEGER) AS n_terms FROM documents")
def term_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(X.terms(F.col("text"))).alias("n_terms"))


def _signal_sql() -> str:
    one = lambda ps: "least(100, 20 * (" + " + ".join("CAST(regexp_matches(t, '(?i)" + p.replace("'", "''") + "') AS INTEGER)" for p in ps) + "))"
    return f"WITH p AS (SELECT doc_id, {_PHRASE} AS t FROM documents) SELECT doc_id, " + ", ".join(f"CAST({one(ps)} AS INTEGER) AS {k}" for k, ps in X.SIGNALS.items()) + " FROM p"


@query("signal_scores", _signal_sql())
def signal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", X.signal_scores(F.expr(_PHRASE)).alias("m"))
    return rows.select("doc_id", *(F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(k) for k in X.SIGNALS))


def _persona_sql() -> str:
    tests = " ".join(f"WHEN regexp_matches(trim(t), '(?i){'|'.join(p)}') THEN '{k}'" for k, p in X.PERSONAS.items())
    lists = lambda table: "CASE persona " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in table.items()) + " ELSE '' END"
    return f"WITH p AS (SELECT doc_id, {_PHRASE} AS t FROM documents), r AS (SELECT doc_id, CASE {tests} ELSE 'open-ended' END AS persona FROM p) SELECT *, {lists(X.PERSONA_INCLUDES)} AS includes, {lists(X.PERSONA_EXCLUDES)} AS excludes FROM r"


@query("persona_route", _persona_sql())
def persona_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", X.persona(F.expr(_PHRASE)).alias("persona"))
    listed = lambda table: F.array_join(X.persona_types(F.col("persona"), table), ",")
    return rows.select("doc_id", "persona", listed(X.PERSONA_INCLUDES).alias("includes"), listed(X.PERSONA_EXCLUDES).alias("excludes"))


@query("media_types", """WITH f AS (SELECT doc_id, CASE doc_id % 24 WHEN 23 THEN NULL WHEN 22 THEN 'plain' WHEN 21 THEN 'a.b/x.UNKNOWN' ELSE concat('src/x.', string_split('TS tsx js jsx md mdx json yaml yml toml py go rs rb java html css exe h txt mD', ' ')[doc_id % 24 + 1]) END AS path,
  string_split('github-pr hn-story hn-comment slack-message doc-page code', ' ')[doc_id % 7 + 1] AS kind FROM documents)
SELECT doc_id, coalesce(CASE lower(string_split(path, '.')[-1]) WHEN 'ts' THEN 'text/typescript' WHEN 'tsx' THEN 'text/typescript' WHEN 'js' THEN 'text/javascript' WHEN 'jsx' THEN 'text/javascript' WHEN 'md' THEN 'text/markdown' WHEN 'mdx' THEN 'text/markdown'
  WHEN 'json' THEN 'application/json' WHEN 'yaml' THEN 'text/yaml' WHEN 'yml' THEN 'text/yaml' WHEN 'toml' THEN 'text/toml' WHEN 'py' THEN 'text/x-python' WHEN 'go' THEN 'text/x-go' WHEN 'rs' THEN 'text/x-rust' WHEN 'rb' THEN 'text/x-ruby' WHEN 'java' THEN 'text/x-java' WHEN 'html' THEN 'text/html' WHEN 'css' THEN 'text/css' END,
  CASE WHEN kind LIKE 'github-%' OR kind IN ('hn-story', 'hn-comment', 'doc-page') THEN 'text/markdown' ELSE 'text/plain' END) AS media_type FROM f""")
def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    pick = lambda words, n: F.get(F.array(*map(F.lit, words.split())), (d % n).cast("int"))
    path = F.when(d % 24 == 22, "plain").when(d % 24 == 21, "a.b/x.UNKNOWN").otherwise(F.concat(F.lit("src/x."), pick("TS tsx js jsx md mdx json yaml yml toml py go rs rb java html css exe h txt mD", 24)))
    return _docs(spark, sf_dir).select("doc_id", X.media_type(path, pick("github-pr hn-story hn-comment slack-message doc-page code", 7)).alias("media_type"))


@query("json_page_rows", """SELECT doc_id, CAST(doc_id % 3 + 1 AS INTEGER) AS n, sha256(concat_ws('|', concat(text, ' see [docs][1] here'), CASE WHEN doc_id % 3 >= 1 THEN 'b] [c' END, CASE WHEN doc_id % 3 = 2 THEN 'd' END)) AS digest FROM documents""")
def json_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of JSON whose texts hold brackets themselves, parsed back."""
    item = lambda c: F.to_json(F.struct(c.alias("body")))
    page = lambda c: F.concat(F.lit("["), item(c), F.lit("]"))
    d, first = F.col("doc_id"), F.concat("text", F.lit(" see [docs][1] here"))
    stream = F.concat(page(first), F.when(d % 3 >= 1, F.concat(F.lit("\n"), page(F.lit("b] [c")))).otherwise(""), F.when(d % 3 == 2, page(F.lit("d"))).otherwise(""))
    rows = _docs(spark, sf_dir).select("doc_id", F.from_json(X.json_pages(stream), "array<struct<body:string>>").alias("x"))
    return rows.select("doc_id", F.size("x").alias("n"), F.sha2(F.array_join("x.body", "|"), 256).alias("digest"))


def strip_sql() -> str:
    out = "html"
    for tag in X.BOILERPLATE_TAGS:
        out = rf"regexp_replace({out}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>', '', 'g')"
    out = f"replace({out}, '<p>', chr(10) || chr(10))"
    out = rf"regexp_replace({out}, '<br\s*/?>', chr(10), 'g')"
    out = rf"""regexp_replace({out}, '<a\s+href="([^"]*)"[^>]*>[^<]*</a>', '\1', 'g')"""
    out = f"regexp_replace({out}, '<[^>]+>', '', 'g')"
    for code, char in X.ENTITIES:
        out = f"replace({out}, '{code}', '{char.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"


@query("html_strip", f"SELECT page_id, length({strip_sql()}) AS n, sha256({strip_sql()}) AS digest FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.html_stripped(X.without_boilerplate(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(out).cast("long").alias("n"), F.sha2(out, 256).alias("digest"))


@query("source_from_url", r"""SELECT page_id, concat(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), CASE WHEN regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) END) AS source,
  contains(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '/de/') AS denied FROM pages""")
def source_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.url_source(url).alias("source"), X.denied_path(url, ["/de/"]).alias("denied"))


def _redact_sql() -> str:
    out = "concat(text, ' sk-or-v1-abcdefgh', doc_id, ' --api-key=x', doc_id, ' Bearer abcdefghijklmnop', doc_id)"
    for p in X.SECRETS:
        out = f"regexp_replace({out}, '{p}', '<redacted>', 'g')"
    return rf"regexp_replace({out}, '(--[a-z][a-z-]*-(?:key|token|secret|password))(\s+|=)\S+', '\1\2<redacted>', 'gi')"


@query("secret_redaction", f"SELECT doc_id, sha256({_redact_sql()}) AS digest FROM documents")
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(" sk-or-v1-abcdefgh"), "doc_id", F.lit(" --api-key=x"), "doc_id", F.lit(" Bearer abcdefghijklmnop"), "doc_id")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.redacted(text), 256).alias("digest"))


@query(
    "chunk_windows",
    """WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 462)) AS o FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(o // 462 AS INTEGER) AS chunk_index, length(substr(text, o + 1, 512)) AS n, sha256(concat_ws(':', doc_id, o // 462, substr(text, o + 1, 512))) AS id FROM s WHERE regexp_matches(substr(text, o + 1, 512), '\\S')""",
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    rows = chunking.windows(docs)
    return rows.select(F.col("id").alias("doc_id"), "chunk_index", F.length("content").cast("long").alias("n"), X.chunk_id(F.col("id"), F.col("chunk_index"), F.col("content")).alias("id"))


@query("markdown_chunks")
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.lit("v1").alias("version"), F.lit("a.md").alias("path"), F.col("text").alias("content"))
    return chunking.split(docs)


@query("cluster_labels", r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '`[^`]*`', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '[#*_~>|\[\](){}]', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 0) AS w FROM documents),
t AS (SELECT doc_id, w, list_slice(list_filter(w, lambda x: regexp_replace(lower(x), '[^a-z0-9-]', '', 'g') <> '' AND NOT list_contains(string_split('""" + " ".join(X.STOP_WORDS) + r"""', ' '), regexp_replace(lower(x), '[^a-z0-9-]', '', 'g'))), 1, 7) AS m FROM w),
l AS (SELECT doc_id, CASE WHEN len(m) >= 5 THEN array_to_string(list_transform(m, lambda x: regexp_replace(x, '[^a-zA-Z0-9-]', '', 'g')), ' ')
  ELSE array_to_string(list_filter(list_transform(list_slice(w, 1, 7), lambda x: regexp_replace(x, '[^a-zA-Z0-9-]', '', 'g')), lambda x: x <> ''), ' ') END AS label FROM t)
SELECT doc_id, CASE WHEN label = '' THEN 'unlabelled cluster' ELSE label END AS label FROM l""")
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.label(F.col("text")).alias("label"))


@query("identity_hashes", """SELECT doc_id, sha256(concat_ws(':', source, doc_id)) AS id, substr(sha256(concat_ws('/', lang, source)), 1, 32) AS collection,
  concat_ws('-', substr(sha256(text), 1, 8), substr(sha256(text), 9, 4), substr(sha256(text), 13, 4), substr(sha256(text), 17, 4), substr(sha256(text), 21, 12)) AS shaped FROM documents""")
def identity_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.chunk_id(F.col("source"), F.col("doc_id")).alias("id"), X.collection_id(F.col("lang"), F.col("source")).alias("collection"), X.shaped_id(F.col("text")).alias("shaped"))


@query("source_normalization", r"""WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('HTTPS://GitHub.com/Acme/', source, '.git') WHEN 1 THEN concat('./SRC/', source, '.git') WHEN 2 THEN concat('http://github.com/', source) WHEN 3 THEN concat('github.com/Acme/', source, '.git') ELSE source END AS s FROM documents)
SELECT doc_id, regexp_replace(CASE WHEN regexp_matches(s, '(?i)^(?:https?://)?github\.com/') THEN lower(regexp_replace(regexp_replace(s, '(?i)^(?:https?://)?github\.com/', ''), '\.git$', '')) ELSE lower(s) END, '^\./', '') AS norm FROM s""")
def source_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("CASE doc_id % 5 WHEN 0 THEN concat('HTTPS://GitHub.com/Acme/', source, '.git') WHEN 1 THEN concat('./SRC/', source, '.git') WHEN 2 THEN concat('http://github.com/', source) WHEN 3 THEN concat('github.com/Acme/', source, '.git') ELSE source END")
    return _docs(spark, sf_dir).select("doc_id", X.repo_source(s).alias("norm"))


@query("low_quality_text", r"SELECT doc_id, length(trim(text)) < 100 OR coalesce(list_sum(list_transform(regexp_extract_all(trim(text), '\[[^\]]*\]\([^)]*\)'), lambda x: length(x))), 0) / length(trim(text)) > 0.5 AS low FROM documents")
def low_quality_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.low_quality(F.col("text")).alias("low"))


@query("length_strata", "SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS bucket, lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM documents GROUP BY ALL")
def length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).groupBy(X.length_bucket(F.col("n_chars")).alias("bucket"), "lang").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("t"))
    return rows.crossJoin(F.broadcast(total)).select("bucket", "lang", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # one row
