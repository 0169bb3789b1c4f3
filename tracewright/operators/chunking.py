"""Splitting documents into chunks: fixed windows in SQL, Markdown and code boundaries in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable

_HEADER = re.compile(r"^#{1,6}\s", re.M)
_BLANK = re.compile(r"\n[ \t]*\n")
_SENTENCE = re.compile(r"[.!?](?=\s)")
#: Starts of definitions by language family.
_BOUNDARY = {
    "python": re.compile(r"^(?:async\s+def|def|class)\s+(\w+)", re.M),
    "javascript": re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum|const|let)\s+(\w+)", re.M),
    "go": re.compile(r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+)(\w+)", re.M),
    "rust": re.compile(r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|impl|mod)\s+(\w+)", re.M),
    "solidity": re.compile(r"^\s*(?:contract|library|interface|function|event|struct)\s+(\w+)", re.M),
    "java": re.compile(r"^\s*(?:public|private|protected)?\s*(?:static\s+)?(?:final\s+)?(?:class|interface|enum|record)\s+(\w+)", re.M),
}
_IMPORTS = {
    "python": re.compile(r"^\s*(?:from\s+\S+\s+import|import)\b"),
    "javascript": re.compile(r"^\s*import\b|^\s*export\b.*\bfrom\b|\brequire\("),
    "go": re.compile(r"^\s*import\b|^\s+(?:\w+\s+)?\"[^\"]+\"\s*$"),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\b"),
    "solidity": re.compile(r"^\s*import\b"),
    "java": re.compile(r"^\s*import\b"),
}
_OPENING = re.compile(r"""\s*(?:/\*.*?(?:\*/|\Z)[ \t]*|//[^\n]*|\#[^\n]*|\"{3}.*?(?:\"{3}|\Z)[^\n]*|'{3}.*?(?:'{3}|\Z)[^\n]*)(?:\n|\Z)""", re.S)
ISSUE_KINDS = {"github-issue": "issue", "github-pr": "PR", "github-discussion": "discussion"}
#: Documents whose pieces a worker holds at once.
PIECES = 64
LANGUAGES = {"py": "python", "ts": "javascript", "tsx": "javascript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "go": "go", "rs": "rust", "sol": "solidity", "java": "java"}


def windows(documents: DataFrame, size: int = 512, overlap: int = 50, text: str = "content") -> DataFrame:
    """(id, chunk_index, offset, content): fixed character windows; blank ones are left out, the last may be short."""
    step = size - overlap
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)))
    rows = documents.select("id", text, F.explode(starts).alias("offset"))
    rows = rows.select("id", "offset", F.substring(text, F.col("offset") + 1, F.lit(size)).alias("content")).where(F.col("content").rlike(r"\S"))
    return rows.withColumn("chunk_index", (F.col("offset") / step).cast("int"))


def markdown_end(text: str, start: int, size: int) -> int:
    """Where a window that starts at ``start`` ends: before its last header, else after its last blank line, else its last sentence, else hard."""
    hard = start + size
    if hard >= len(text):
        return len(text)
    window = text[start:hard]
    for pattern, at in ((_HEADER, "start"), (_BLANK, "end"), (_SENTENCE, "end")):
        cuts = [getattr(m, at)() for m in pattern.finditer(window)]
        cuts = [c for c in cuts if c > 0]
        if cuts:
            return start + cuts[-1]
    return hard


def markdown_pieces(text: str, size: int = 512, overlap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of each piece; every piece moves forward by one character at least."""
    out, start = [], 0
    overlap = max(0, min(overlap, size - 1))
    while start < len(text):
        end = markdown_end(text, start, size)
        if text[start:end].strip():
            out.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def code_pieces(text: str, language: str, size: int = 4000) -> list[tuple[int, int, str | None]]:
    """(start, end, symbol): a preamble, then one piece for each definition, cut at ``size``."""
    found = [(m.start(), m.group(1)) for m in _BOUNDARY.get(language, re.compile(r"(?!)")).finditer(text)]
    marks: list[tuple[int, str | None]] = [(0, None)] if not found or found[0][0] > 0 else []
    marks += found
    ends = [m[0] for m in marks[1:]] + [len(text)]
    out = []
    for (a, symbol), b in zip(marks, ends, strict=True):
        out += [(x, min(x + size, b), symbol) for x in range(a, b, size) if text[x : min(x + size, b)].strip()]
    return out


def split(documents: DataFrame, size: int = 512, overlap: int = 0) -> DataFrame:
    """Chunks of documents (id, version, path, content): code by definition, everything else as Markdown.

    A chunk's id is the sha256 of id:version:index:content. Null content gives no chunk.
    """

    names = ["document_id", "version", "chunk_index", "total_chunks", "start", "end", "symbol", "content", "line"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PIECES):
                rows = []
                for i, v, p, t in zip(*(batch.slice(at, PIECES).column(c).to_pylist() for c in ("id", "version", "path", "content")), strict=True):
                    language = LANGUAGES.get((p or "").rpartition(".")[2].lower())
                    pieces = code_pieces(t or "", language) if language else [(a, b, None) for a, b in markdown_pieces(t or "", size, overlap)]
                    line, seen = 1, 0
                    for k, (a, b, s) in enumerate(pieces):
                        line, seen = line + t.count("\n", seen, a), a  # each line end is counted once
                        rows.append((i, v, k, len(pieces), a, b, s, t[a:b], line))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    importable(documents.sparkSession)
    schema = "document_id string, version string, chunk_index int, total_chunks int, start int, end int, symbol string, content string, line int"
    out = documents.select(F.col("id").cast("string").alias("id"), F.col("version").cast("string").alias("version"), "path", "content").mapInArrow(run, schema)
    return out.withColumn("id", F.sha2(F.concat_ws(":", "document_id", "version", "chunk_index", "content"), 256))


def chunker_name(source_type: Column, path: Column) -> Column:
    """Which chunker a document goes to."""
    ending = F.lower(F.element_at(F.split(F.coalesce(path, F.lit("")), r"\."), -1))
    return (
        F.when(source_type.isin(list(ISSUE_KINDS)), "github-issue").when(ending.isin("md", "mdx") | (source_type == "markdown"), "markdown")
        .when(ending.isin(list(LANGUAGES)), "hierarchical-code").otherwise("code-window")
    )


def opening_comment(text: str) -> str:
    """The comments that a source file begins with."""
    end = 0
    while found := _OPENING.match(text, end):
        end = found.end()
    return "\n".join(line.rstrip() for line in text[:end].split("\n")).strip()


def file_summary(source: str, text: str, language: str) -> str | None:
    """A file's opening comment, imports and symbols; None if it has none of them."""
    parts = [opening_comment(text)]
    imports = [line.rstrip() for line in text.split("\n") if language in _IMPORTS and _IMPORTS[language].search(line)]
    symbols = dict.fromkeys(s for _, _, s in code_pieces(text, language) if s)
    parts += ["\n".join(["Imports:", *imports]) if imports else "", "\n".join(["Symbols:", *(f"- {s}" for s in symbols)]) if symbols else ""]
    return "\n\n".join([f"File: {source}", *filter(None, parts)]) if any(parts) else None


def summaries(documents: DataFrame) -> DataFrame:
    """(document_id, version, id, content): the file-level chunk of each source file (id, version, path, content) that has something to tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v, p, t in zip(*(batch.column(c).to_pylist() for c in ("id", "version", "path", "content")), strict=True):
                language = LANGUAGES.get((p or "").rpartition(".")[2].lower())
                made = file_summary(p, t or "", language) if language and (t or "").strip() else None
                if made:
                    rows.append((i, v, made))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["document_id", "version", "content"])

    importable(documents.sparkSession)
    rows = documents.select(F.col("id").cast("string").alias("id"), F.col("version").cast("string").alias("version"), "path", "content")
    out = rows.mapInArrow(run, "document_id string, version string, content string")
    return out.select("document_id", "version", F.sha2(F.concat_ws(":", "document_id", "version", F.lit("summary"), "content"), 256).alias("id"), "content")


def issue_context(source_type: Column, source: Column, number: Column, content: Column, labels: Column) -> Column:
    """What stands above every chunk of an issue, pull request or discussion."""
    repo = F.when(F.contains(source, F.lit("#")), F.substring_index(source, "#", 1)).otherwise(F.substring_index(source, "/discussions/", 1))
    title = F.coalesce(F.nullif(F.regexp_extract(content, r"^#\s+(.+)", 1), F.lit("")), source)
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in ISSUE_KINDS.items() for x in kv)), source_type), F.lit("issue"))
    marks = F.when(F.coalesce(labels, F.lit("")) == "", "").otherwise(F.concat(F.lit("Labels: "), labels, F.lit("\n")))
    return F.concat(repo, F.lit(" "), kind, F.lit(" "), F.coalesce(number, F.lit("")), F.lit(": "), title, F.lit("\n"), marks, F.lit("---\n"))


def oversized(chunks: DataFrame, most: int = 4000) -> DataFrame:
    """Chunks of more than ``most`` characters cut in windows that keep the parent's id; the others as they are."""
    small = chunks.where(F.length("content") <= most).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent_id"), "content")
    big = windows(chunks.where(F.length("content") > most), most, 0)
    return small.unionByName(big.select(F.sha2(F.concat_ws(":", "id", "chunk_index", "content"), 256).alias("id"), F.col("id").cast("string").alias("parent_id"), "content"))


def rechunked(chunks: DataFrame, most: int = 4000) -> DataFrame:
    """Chunks (id, document_id, version, content, fingerprint and others) with those of more than ``most`` characters cut where Markdown allows.

    A piece gets a new id and fingerprint, and ``parent_id`` names the chunk
    it comes from; ``piece`` counts from 0; the other columns stay. Only long chunks go through Python.
    """
    importable(chunks.sparkSession)

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def cuts(content: pd.Series) -> pd.Series:
        return content.map(lambda t: [{"start": a, "end": b} for a, b in markdown_pieces(t, most, 0)])

    long = F.coalesce(F.length("content"), F.lit(0)) > most
    small = chunks.where(~long).withColumns({"parent_id": F.lit(None).cast("string"), "piece": F.lit(0)})
    pieces = chunks.where(long).select("*", F.posexplode(cuts("content")).alias("piece", "_p"))
    content = F.substring("content", F.col("_p.start") + 1, F.col("_p.end") - F.col("_p.start"))
    cut = pieces.withColumn("parent_id", F.col("id")).withColumn("content", content)
    cut = cut.withColumn("id", F.sha2(F.concat_ws(":", "document_id", "version", "piece", "content"), 256)).withColumn("fingerprint", F.sha2("content", 256))
    return small.unionByName(cut.drop("_p"))
