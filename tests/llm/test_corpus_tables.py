"""Token alignment, line deduplication and importance resampling against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tracewright.llm import alignment, kernels, lines, queries, resample

HARD = [
    None, "", " ", "\n", "hello world", "Hello  world \n\n\tx", "<|endoftext|> and <s> </s> <unk>", "▁ marker ▁", "naïve café, 中文字符 and 日本語 テスト", "🙂🙂 emoji 👩‍👩‍👧", "\x00\x01 control \x7f",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "it's we'll I'd they've 12345 3.14", " leading", "trailing   ", "é", "é", " nbsp em", "мир и война", "x" * 3000, "hello world", "HELLO world " * 50,
]


@pytest.fixture(scope="module")
def files():
    return alignment.Vocabularies.load(queries.BYTE_TOKENIZER, queries.TOKENIZER)


def brute_alignment(texts):
    """Ends as sets, links as loops; tokens by the vocabularies' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    slow.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    byte = alignment.byte_characters()
    out, docs = [], collections.Counter()
    for t in texts:
        if not t:
            out.append(([], [], []))
            continue
        a = slow.encode(" " + t, add_special_tokens=False)
        token_a = [bytes(byte[c] for c in x) for x in a.tokens]
        b = sp.encode(t)
        token_b = [bytes([int(x[1:-1], 16)]) if re.fullmatch("<0x..>", x) else x.replace("▁", " ").encode() for x in (sp.id_to_piece(i) for i in b)]
        if not b"".join(token_a) == b"".join(token_b) == (" " + t).encode():
            out.append(([], [], []))
            continue
        end = lambda tokens: np.cumsum([len(x) for x in tokens]).tolist()
        both, groups, last = sorted(set(end(token_a)) & set(end(token_b))), [], 0
        for cut in both:
            groups.append(([i for i, e in zip(a.ids, end(token_a)) if last < e <= cut], [i for i, e in zip(b, end(token_b)) if last < e <= cut]))
            last = cut
        out.append((a.ids, b, groups))
        docs.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    best = {}
    for (x, _), n in docs.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for a, b, groups in out:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(docs[p] == best[p[0]] for p in links), sum(docs[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return rows


def test_vocabularies_give_the_libraries_ids(files):
    made = alignment.encoders(files)
    assert made.fast is not None
    for t in HARD:
        if t:
            assert made.encode_a(" " + t) == made.slow.encode(" " + t, add_special_tokens=False).ids
    for t in (" " * 2500 + "x", "a\n" + " \n" * 1500 + "b c", "x" + "\t" * 1200):
        assert made._blank(t) == made.encode_a(t) == made.slow.encode(t, add_special_tokens=False).ids
    blank = "a " + " " * 1_500_000 + "b"  # more than the pattern takes
    assert b"".join(made.bytes_a[i] for i in made.encode_a(blank)) == blank.encode()


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.one_of(st.sampled_from(HARD), st.text("a b\n\t.\xa0é\u2028\x1c\x851", max_size=30), st.text(max_size=20)), min_size=1, max_size=5))
def test_words_are_encoded_as_within_their_text(files, texts):
    made = alignment.encoders(files)
    whole = lambda t: made.slow.encode(" " + t, add_special_tokens=False).ids
    for _ in range(2):  # the second time from memory
        for t, (a, b, sizes) in zip(texts, made.encode(texts), strict=True):
            ids_b = made.pieces_b.encode(t or "")
            want = (" " + t).encode() if t else None
            if t and b"".join(made.bytes_b[i] for i in ids_b) == want and b"".join(made.bytes_a[i] for i in whole(t)) == want:
                assert np.frombuffer(a, np.int32).tolist() == whole(t) and np.frombuffer(b, np.int32).tolist() == ids_b
                n_a, n_b = np.frombuffer(sizes, np.int32).reshape(-1, 2).T
                assert (n_a.sum(), n_b.sum()) == (len(a) // 4, len(b) // 4)
            else:
                assert (a, b, sizes) == (b"", b"", b"")


@pytest.mark.parametrize("room", [1_000_000, 150, 0])
def test_op11_equals_brute_force(spark, files, room, monkeypatch):
    monkeypatch.setattr(alignment, "EXPANDED", 64)
    texts = HARD + ["hello world again", "the café"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_a string").repartition(3)
    rows = alignment.scored(docs, files, broadcast_rows=room).orderBy("doc_id").collect()
    assert [(r.n_a_, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows] == brute_alignment(texts)
    assert {r.n_a for r in rows} == {"x"}


def test_op11_given_documents(spark, files):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(20)
    rows = alignment.scored(docs, files).orderBy("doc_id").collect()
    want = brute_alignment([r.text for r in docs.orderBy("doc_id").collect()])
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows] == want


def test_op11_no_rows_and_string_ids(spark, files):
    assert alignment.scored(spark.createDataFrame([], "doc_id long, text string"), files).collect() == []
    rows = alignment.scored(spark.createDataFrame([("u", "one two"), (None, "one two"), ("u", None)], "doc_id string, text string"), files).collect()
    assert sorted((r.doc_id or "", r.n_a, r.count_sum) for r in rows) == [("", 2, 4), ("u", 0, 0), ("u", 2, 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=8), st.lists(st.integers(1, 4), min_size=1, max_size=8)), max_size=4))
def test_groups_are_cut_where_both_end(texts):
    ends_a, ends_b, base = [], [], 0
    for a, b in texts:
        n = max(sum(a), sum(b))
        a, b = [*a, n - sum(a)], [*b, n - sum(b)]
        ends_a += [base + e for e in np.cumsum([x for x in a if x])]
        ends_b += [base + e for e in np.cumsum([x for x in b if x])]
        base += n
    n_a, n_b = alignment.groups(alignment.labels(np.array(ends_a, int), np.array(ends_b, int), base))
    cuts = sorted(set(ends_a) & set(ends_b))
    count = lambda ends: np.diff([0, *[sum(e <= c for e in ends) for c in cuts]]).tolist()
    assert n_a.tolist() == count(ends_a) and n_b.tolist() == count(ends_b)


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def brute_lines(docs, chars, least):
    holders = collections.defaultdict(set)
    for d in set(docs):
        for line in (d[1] or "").split("\n"):
            if len(key(line)) >= max(chars, 1):
                holders[key(line)].add(d)
    rank = lambda i: (i is not None, i)
    lead = {k: max((d[0] for d in of), key=rank) for k, of in holders.items() if len(of) >= least}
    out = []
    for d, t in docs:
        every = (t or "").split("\n")
        kept = [x for x in every if key(x) not in lead or lead[key(x)] == d]
        out.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_corpus(seed, n=120):
    rng = random.Random(seed)
    shared = [f"Shared line {i} é" + "." * rng.randint(0, 9) for i in range(25)]
    docs = []
    for i in range(n):
        own = [rng.choice(["  {}\t", "{}", "{} \r"]).format(rng.choice([str.upper, str, str])(rng.choice(shared[: rng.randint(1, 25)]))) for _ in range(rng.randint(0, 8))]
        own += ["HOT line that is everywhere"] * (i % 3) + ["", "  ", f"own {rng.random()}"][: rng.randint(0, 3)]
        rng.shuffle(own)
        docs.append((i, "\n".join(own)))
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, "hot LINE that is everywhere\n"), (503, "hot LINE that is everywhere\n"), (503, "other\nhot line that is everywhere"), (None, "hot line that is everywhere\nx")]
    return docs


@pytest.mark.parametrize(("chars", "least", "parts"), [(10, 5, 40), (10, 2, 3), (1, 5, 17), (26, 30, 60)])
def test_op12_equals_brute_force(spark, chars, least, parts):
    docs = line_corpus(chars + parts)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, line_dedup string").repartition(3)
        rows = lines.deduplicated(frame, chars, least).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before[1])
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted([(r.doc_id, r.line_dedup_.n_lines, r.line_dedup_.n_dropped, r.text) for r in rows], key=str) == brute_lines(docs, chars, least)
    assert {r.line_dedup for r in rows} == {"x"}


def test_op12_bitmaps_and_string_ids(spark):
    text = "keep\nThis is a line of the footer\nkeep too"
    docs = [(f"d{i}", text) for i in range(3)] + [("e", None)]
    rows = {r.doc_id: r for r in lines.keep_bitmaps(spark.createDataFrame(docs, "doc_id string, text string"), 12, 3).collect()}
    bits = lambda r: np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8), count=r.n_lines).tolist()
    assert bits(rows["d0"]) == bits(rows["d1"]) == [1, 0, 1] and bits(rows["d2"]) == [1, 1, 1] and bits(rows["e"]) == [1]
    assert lines.deduplicated(spark.createDataFrame([], "doc_id string, text string")).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), st.integers(0, 6)), st.integers(0, 2), st.integers(0, 2)), max_size=40, unique=True), st.integers(1, 4), st.lists(st.integers(0, 40), max_size=5), st.integers(1, 5))
def test_stream_over_any_cut(rows, least, cuts, size):
    """Partitions end anywhere between two documents; batches anywhere."""
    order = lambda r: (r[0], r[1] is None, -(r[1] or 0), r[2], r[3])
    rows = sorted(rows, key=order)
    cuts = sorted(c for c in set(cuts) if c == 0 or c >= len(rows) or rows[c - 1][:3] != rows[c][:3])
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("line", pa.int32())])
    found = []
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        part = [pa.RecordBatch.from_pylist([dict(zip(schema.names, (r[0], 0, *r[1:]), strict=True)) for r in rows[a:b][i : i + size]], schema) for i in range(0, len(rows[a:b]), size)]
        for batch in lines._streamed(least)(iter(part)):
            found += batch.to_pylist()
    total, lead = collections.Counter(), {}
    for r in found:
        if r["kind"] == lines.SUMMARY:
            total[r["h1"]] += r["docs"]
            lead[r["h1"]] = max(lead.get(r["h1"], -1), -1 if r["doc_id"] is None else r["doc_id"])
    gone = [(r["h1"], r["doc_id"], r["text_hash"], r["line"]) for r in found if r["kind"] == lines.CERTAIN or (r["kind"] == lines.WAITING and total[r["h1"]] >= least and (-1 if r["doc_id"] is None else r["doc_id"]) != lead[r["h1"]])]
    want = []
    for h in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == h]
        if len({r[1:3] for r in own}) >= least:
            want += [r for r in own if r[1] != own[0][1]]
    assert sorted(gone, key=order) == sorted(want, key=order)


def test_op12_op13_equal_sql(agree):
    for name in ("op12_line_dedup", "op13_importance_resampling"):
        agree(queries.QUERIES[name], queries.ORACLE_SQL[name])


def features(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", key(text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.text("abAB ,1é中\n", max_size=40), st.sampled_from(["word " * 30, "q" * 700 + " b " + "z" * 300])), min_size=1, max_size=6), st.integers(1, 4))
def test_buckets_of_any_ngram(texts, most):
    data, offsets = kernels.raw(pa.array(texts))
    count, docs, found = resample.buckets_of(data, offsets, most, 1000)
    for i, t in enumerate(texts):
        w, want = features(t, most)
        assert count[i] == len(w)
        got = [b for d, f in zip(docs, found, strict=True) for b in f[d == i].tolist()]
        assert got == [zlib.crc32(f.encode()) % 1000 for f in want]


@pytest.mark.parametrize(("most", "buckets", "percent"), [(2, 10_000, 25), (3, 50, 60)])
def test_op13_equals_brute_force(spark, most, buckets, percent):
    rng = random.Random(most)
    word = lambda: rng.choice(["Alpha", "beta", "GAMMA", "é", "delta9", "x"])
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(90, None), (91, ""), (92, "..."), (93, "a " * 30), (93, "a " * 30), (94, "a " * 30)]
    target = [(1, "alpha beta gamma"), (2, None), (3, "é é")]
    ours, theirs = (collections.Counter(zlib.crc32(f.encode()) % buckets for _, t in rows for f in features(t, most)[1]) for rows in (docs, target))
    s, t = sum(ours.values()), sum(theirs.values())
    gain = [math.floor(1000 * math.log((theirs[b] + 1) * (s + buckets) / ((ours[b] + 1) * (t + buckets)))) for b in range(buckets)]
    want = []
    for d, text in docs:
        w, fs = features(text, most)
        h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) // len(fs) if fs else 0
        want.append([d, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    for place, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = place
    d = spark.createDataFrame([(i, x, "x") for i, x in docs], "doc_id long, text string, score string").repartition(5)
    rows = resample.resampled(d, spark.createDataFrame(target, "item_id long, text string"), percent, 20, most, buckets).collect()
    assert sorted([list(r) for r in rows], key=str) == sorted(want, key=str)


def test_op13_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resampled(empty, empty).collect() == []
    (row,) = resample.resampled(spark.createDataFrame([(None, "word " * 20)], "doc_id string, text string"), empty, percent=100).collect()
    assert (row.n_words, row.rank) == (20, 1)
    assert resample.resampled(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), empty).select(F.max("rank")).first()[0] is None
