"""Text functions: identity, cleaning, shingles, signals, routing, redaction, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.edges import repo_source  # noqa: F401  (part of this module's surface)

# Signal patterns, routing rules, secret patterns, stop words, media types.
SIGNALS = {
    "pain": [r"doesn't work", "broken", "unusable", "frustrated", r"\bbug\b", r"\berror\b", r"\bcrash", r"\bfail", "timeout", "can't", r"\bunable\b"],
    "praise": ["love this", "works great", "exactly what I needed", "awesome", "thank you", "perfect", "amazing", "fantastic"],
    "feature_request": ["wish there was", "would be nice", "any plans to", "feature request", "please add", "it would be great if", "can we have"],
    "workaround": ["instead I", "wrote a script", "hack around", "temporary fix", "workaround", r"\bmanually\b"],
    "question": ["how do I", "is there a way", "can someone explain", "where do I find", "what is", "how to", "anyone know"],
}
PERSONAS = {
    "docs": [r"\bdocs? (?:say|describe|explain|cover)\b", r"\bwhat do the docs\b", r"\bdocumentation (?:for|on|about)\b", r"\bin the documentation\b", r"\brefer(?:ence)? docs?\b"],
    "discussion": [r"\bdiscuss(?:ed|es|ing|ion|ions)?\b", r"\bdebate(?:d|s)?\b", r"\bargu(?:e|ed|es|ing|ments?)\b", r"\bconversation\b", r"\bpeople (?:say|said|think)\b", r"\bsay(?:ing)? about\b", r"\bopinions?\b"],
    "changes": [r"\bwhat changed\b", r"\bwhat (?:was|were) (?:changed|modified|updated)\b", r"\brecent(?:ly)? (?:chang|updat)", r"\bfix(?:ed|es)?\b", r"\bbug (?:fixes?|fixed)\b", r"\breleases?\b", r"\blast release\b", r"\bchangelog\b"],
    "technical": [r"\bhow does?\b", r"\bhow is\b", r"\bhow do\b", r"\bimplement(?:ed|ation|s)?\b", r"\bfunction(?:s|ality)?\b", r"\balgorithm\b", r"\barchitect(?:ure|ed)\b", r"\bcode (?:work|path|flow)\b"],
}
PERSONA_BOOSTS = {
    "docs": {"doc-page": 1.2, "markdown": 1.1},
    "discussion": {"github-pr-comment": 1.2, "github-issue": 1.2, "github-discussion": 1.2, "slack-message": 1.15, "discord-message": 1.15, "doc-page": 0.7},
    "changes": {"github-pr": 1.2, "github-pr-comment": 1.1, "markdown": 1.1, "doc-page": 0.8},
    "technical": {"code": 1.2, "markdown": 1.1, "doc-page": 0.7},
    "open-ended": {},
}
PERSONA_INCLUDES = {
    "docs": ["doc-page", "markdown"],
    "discussion": ["github-issue", "github-pr", "github-pr-comment", "github-discussion", "slack-message", "discord-message"],
    "changes": ["github-pr", "github-issue", "markdown", "code"],
    "technical": ["code", "markdown"],
}
PERSONA_EXCLUDES = {"technical": ["doc-page"]}
MEDIA_TYPES = {
    "ts": "text/typescript", "tsx": "text/typescript", "js": "text/javascript", "jsx": "text/javascript", "md": "text/markdown", "mdx": "text/markdown", "json": "application/json", "yaml": "text/yaml", "yml": "text/yaml",
    "toml": "text/toml", "py": "text/x-python", "go": "text/x-go", "rs": "text/x-rust", "rb": "text/x-ruby", "java": "text/x-java", "html": "text/html", "css": "text/css",
}
SECRETS = [r"sk-or-v1-[A-Za-z0-9]{8,}", r"sk-ant-[A-Za-z0-9_-]{16,}", r"sk-proj-[A-Za-z0-9_-]{16,}", r"sk-[A-Za-z0-9]{20,}", r"ghp_[A-Za-z0-9]{20,}", r"gho_[A-Za-z0-9]{20,}", r"ghu_[A-Za-z0-9]{20,}", r"Bearer [A-Za-z0-9._-]{16,}"]
SECRET_ARGUMENT = r"(?i)(--[a-z][a-z-]*-(?:key|token|secret|password))(\s+|=)\S+"
BOILERPLATE_TAGS = ["nav", "footer", "aside", "script", "style", "noscript"]
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#x2F;", "/")]
STOP_WORDS = (
    "a an and are as at be but by do for from had has have he her his how i if in into is it its just me my no not of on or our out so some than that the their them then there these "
    "they this to up us was we were what when which who will with would you your"
).split()
CONFIG_SOURCES = r"(?i)package\.json$|tsconfig[^/]*\.json$|\.lock$|package-lock\.json$|yarn\.lock$|pnpm-lock\.yaml$|changelog\.md$|\.eslintrc|\.prettierrc|biome\.json$"
PLACEHOLDER_REPOS = ["owner/repo", "org/repo", "user/repo", "your-org/your-repo", "example/repo", "username/repository", "my-org/my-repo", "acme/my-repo"]


def chunk_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def collection_id(namespace: Column, name: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("/", namespace, name), 256), 1, 32)


def shaped_id(text: Column) -> Column:
    """The sha256 of a text in the shape of a UUID."""
    h = F.sha2(text, 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def url_source(url: Column) -> Column:
    """Lower-case host and path; an empty path is a slash, a bad address null."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("PATH"))
    return F.concat(F.lower(host), F.when(path == "", "/").otherwise(path))


def denied_path(url: Column, patterns: list[str]) -> Column:
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    out = F.lit(False)
    for p in patterns:
        out = out | path.contains(p)
    return out


def html_stripped(html: Column) -> Column:
    out = F.replace(html, F.lit("<p>"), F.lit("\n\n"))
    out = F.regexp_replace(out, r"<br\s*/?>", "\n")
    out = F.regexp_replace(out, r'<a\s+href="([^"]*)"[^>]*>[^<]*</a>', "$1")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for code, char in ENTITIES:
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def without_boilerplate(html: Column) -> Column:
    out = html
    for tag in BOILERPLATE_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", "")
    return out


def low_quality(text: Column) -> Column:
    """Under 100 characters, or over half of them in Markdown links."""
    t = F.trim(text)
    links = F.aggregate(F.regexp_extract_all(t, F.lit(r"\[[^\]]*\]\([^)]*\)"), F.lit(0)), F.lit(0), lambda s, x: s + F.length(x))
    return (F.length(t) < 100) | (links / F.length(t) > 0.5)


def shingles(text: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` words of the lower-case text without link targets and addresses."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\]\([^)]*\)", "]"), r"https?://\S+", "")
    words = F.filter(F.split(bare, r"[^a-z0-9_]+"), lambda w: w != "")
    places = lambda w: F.when(F.size(w) >= size, F.sequence(F.lit(1), F.size(w) - size + 1)).otherwise(F.array().cast("array<int>"))
    runs = lambda w: F.array_distinct(F.transform(places(w), lambda i: F.array_join(F.slice(w, i, size), " ")))
    return F.get(F.transform(F.array(words), runs), F.lit(0))  # the words are split once, not once a shingle


def word_hashes(text: Column) -> Column:
    """The words that ``shingles`` are runs of as 64-bit hashes, in order; none without text."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\]\([^)]*\)", "]"), r"https?://\S+", "")
    words = F.filter(F.split(bare, r"[^a-z0-9_]+"), lambda w: w != "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def terms(text: Column) -> Column:
    """Distinct lower-case words of more than two characters, split at white space and punctuation."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s\p{P}]+"), lambda w: F.length(w) > 2))


def signal_scores(text: Column) -> Column:
    """A map of the signals that match: min(100, matches / 5 in percent)."""
    score = lambda patterns: F.least(F.lit(100), F.round(sum((text.rlike(f"(?i){p}").cast("int") for p in patterns), F.lit(0)) * 20).cast("int"))
    every = F.create_map(*(x for k, p in SIGNALS.items() for x in (F.lit(k), score(p))))
    return F.map_filter(every, lambda _, v: v > 0)


def persona(text: Column) -> Column:
    """The first routing rule that matches, else ``open-ended``."""
    t, out = F.trim(text), None
    for name, patterns in PERSONAS.items():
        test = t.rlike("(?i)" + "|".join(patterns))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("open-ended")


def persona_types(persona_name: Column, table: dict[str, list[str]]) -> Column:
    """The source types that a routing rule includes or excludes (``PERSONA_INCLUDES``, ``PERSONA_EXCLUDES``); none for the others."""
    out = F.array().cast("array<string>")
    for name, kinds in table.items():
        out = F.when(persona_name == name, F.array(*map(F.lit, kinds))).otherwise(out)
    return out


def redacted(text: Column) -> Column:
    out = text
    for p in SECRETS:
        out = F.regexp_replace(out, p, "<redacted>")
    return F.regexp_replace(out, SECRET_ARGUMENT, "$1$2<redacted>")


def is_config(source: Column, source_type: Column) -> Column:
    return source_type.isin("config", "lockfile") | source.rlike(CONFIG_SOURCES)


def is_placeholder_repo(repo: Column) -> Column:
    return F.lower(repo).isin(PLACEHOLDER_REPOS) | repo.rlike(r"^[^/]*/.*\.\w{1,6}$")


def label(text: Column, least: int = 5, most: int = 7, head: int = 64) -> Column:
    """The first seven words that are no stop words; all first seven if under five are left.

    The first ``head`` words are tried before all others: mostly they have
    enough. A pattern runs only on texts that have a character it needs.
    """
    out = text
    for sign, p in (("`", r"(?s)```.*?```"), ("`", "`[^`]*`"), ("<", "<[^>]+>"), ("&", "&[a-z]+;"), (None, r"[#*_~>|\[\](){}]+"), ("://", r"https?://\S+")):
        changed = F.regexp_replace(out, p, " ")
        out = changed if sign is None else F.when(F.contains(text, F.lit(sign)), changed).otherwise(out)
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  (worked out once)
    bare = lambda w: F.regexp_replace(w, "[^a-zA-Z0-9-]", "")
    lower = lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9-]", "")
    useful = lambda w: bound(lower(w), lambda x: (F.length(x) > 0) & ~x.isin(STOP_WORDS))
    told = lambda words: F.slice(F.filter(words, useful), 1, most)
    written = lambda words: F.filter(words, lambda w: F.length(w) > 0)

    def of(clean: Column) -> Column:
        # What stands behind the first words is the last element, where there are more.
        first = bound(F.split(clean, r"\s+", head + 1), lambda parts: F.struct(written(F.slice(parts, 1, head)).alias("words"), (F.size(parts) > head).alias("more")))
        return bound(first, from_words)

    def from_words(h: Column) -> Column:
        def chosen(t: Column) -> Column:
            plain = F.filter(F.transform(F.slice(h["words"], 1, most), bare), lambda w: F.length(w) > 0)
            return F.when(F.size(t) >= least, F.array_join(F.transform(t, bare), " ")).otherwise(F.array_join(plain, " "))

        return bound(bound(told(h["words"]), lambda t: F.when(~h["more"] | (F.size(t) == most), t).otherwise(told(written(F.split(out, r"\s+"))))), chosen)

    return bound(of(out), lambda chosen: F.when(chosen == "", "unlabelled cluster").otherwise(chosen))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def media_type(path: Column, source_type: Column) -> Column:
    """A media type by file ending, else by source type; plain text if neither tells."""
    known = _looked_up(MEDIA_TYPES, F.lower(F.element_at(F.split(path, r"\."), -1)))
    prose = source_type.startswith("github-") | source_type.isin("hn-story", "hn-comment", "doc-page")
    return F.coalesce(known, F.when(prose, "text/markdown").otherwise("text/plain"))


def duration_seconds(text: Column) -> Column:
    """Seconds of 90d, 48h, 30m or 15s; null for anything else."""
    unit = F.regexp_extract(text, r"^(\d+)([dhms])$", 2)
    factor = F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).when(unit == "s", 1)
    return F.regexp_extract(text, r"^(\d+)([dhms])$", 1).try_cast("long") * factor


def length_bucket(n: Column) -> Column:
    return F.when(n < 500, "short").when(n < 2000, "medium").otherwise("long")


def json_pages(text: Column) -> Column:
    """Concatenated pages [..][..] as one JSON array.

    Only brackets between pages are joined: the text is cut into strings
    (with their escapes) and the runs between them, and strings stay as they are.
    """
    parts = F.regexp_extract_all(text, F.lit(r'"(?:[^"\\]|\\.)*+"|[^"]++'), F.lit(0))
    joined = lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\]\s*\[", ","), r"\[[\s,]*,", "["), r",[\s,]*\]", "]")  # noqa: E731  (empty pages leave no comma)
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(joined(p))), "")
