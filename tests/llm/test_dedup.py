"""Near-duplicates and suffix-array deduplication against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import common, components, kernels, neardup, queries, suffixarray


def roots(n, pairs):
    top = list(range(n))

    def f(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[f(a)] = f(b)
    return [f(x) for x in range(n)]


def brute_near(docs, k, percent):
    sets = []
    for _, t in docs:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    pairs = [(a, b) for a in range(len(docs)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = roots(len(docs), pairs)
    out = []
    for a, (d, _) in enumerate(docs):
        least = min((docs[b][0] for b in range(len(docs)) if root[b] == root[a] and docs[b][0] is not None), default=None)
        out.append((d, len(sets[a]), least, d is not None and d == least))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: str(rng.randint(0, 10**6))
    base, passage, docs = [word() for _ in range(150)], [word() for _ in range(60)], []
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(150)] = word()
        docs.append((len(docs) * 3, " ".join(w)))
    docs += [(1000 + i, " ".join([word() for _ in range(rng.randint(20, 90))] + passage)) for i in range(40)]
    docs += [(2000, None), (2001, ""), (2002, "one two"), (2003, "ONE  two"), (2004, "x"), (2004, "x"), (None, "x"), (2005, docs[0][1]), (2006, "\t \n")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("small", "hot"), [(8, 500), (2, 3)])
def test_near_duplicates(spark, monkeypatch, small, hot):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(common, "HOT", hot)
    docs = corpus(small)
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = neardup.near_duplicates(rows, 3, 85).collect()
    assert sorted(map(tuple, got), key=str) == brute_near(docs, 3, 85)
    # Of each component one row stays: every one without doc_id or words, and the one with the smallest doc_id.
    least = {r[2] for r in got if r[0] is not None and r[1]}
    wordless = [d for d in docs if d[0] is not None and not (d[1] or "").split()]
    left = neardup.deduplicated(rows, 3, 85).collect()
    assert sorted([r.doc_id for r in left if r.doc_id is not None and (r.text or "").split()]) == sorted(least)
    assert len(left) == len(least) + len(wordless) + sum(d[0] is None for d in docs)


def test_ids_that_repeat(spark):
    """Texts under one doc_id, and texts that only rows without doc_id hold, are linked as others are."""
    rng = random.Random(5)
    word = lambda: str(rng.randint(0, 10**6))
    a, b = [word() for _ in range(100)], [word() for _ in range(100)]
    near = lambda w: " ".join([*w[:-1], word()])
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (None, near(b)), (None, near([word() for _ in range(50)])), (4, " ".join(b))]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert sorted(map(tuple, got), key=str) == brute_near(docs, 3, 85)


def test_op4_equals_sql(agree):
    agree(queries.QUERIES["op4_near_dedup"], queries.OP4_SQL)


@pytest.mark.parametrize("name", ["op9_suffix_array", "lm_base_scores", "edited_texts"])
def test_equals_sql(agree, name):
    agree(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deduplicated_keeps_columns(spark):
    t = " ".join(map(str, range(40)))
    docs = spark.createDataFrame([(2, t, 1, 2), (1, t, 2, 3), (1, t, 2, 3), (3, None, 3, 4), (4, None, 4, 5), (None, t, 5, 6)], "doc_id long, text string, node int, _gone int")
    for name in ("th", "row", "Own", "least", "n_shingles"):
        left = neardup.deduplicated(docs.withColumnRenamed("node", name))
        assert left.columns == ["doc_id", "text", name, "_gone"]
        assert sorted(map(tuple, left.collect()), key=str) == [(1, t, 2, 3), (3, None, 3, 4), (4, None, 4, 5), (None, t, 5, 6)]


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, 400, dtype=np.uint64), rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    other = np.concatenate([a[:300], b])  # 300 of 500
    doc = np.repeat([0, 1, 2], [400, 400, 1])
    s = neardup.sketch(doc, np.concatenate([a, other, a[:1]]), 3)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()  # a single shingle fills every bin


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    root = roots(200, pairs)
    want = {x: min(y for y in range(200) if root[y] == root[x]) for p in pairs if p[0] != p[1] for x in p}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_joined_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(70)]
    frame = lambda p: spark.createDataFrame(p, "u long, v long")
    got = dict(map(tuple, neardup.joined(components.components(frame(pairs[:40])), frame(pairs[40:])).collect()))
    assert got == dict(map(tuple, components.components(frame(pairs)).collect()))


def brute_removed(docs, length):
    first = {}
    for d, t in docs:
        if d is not None:
            for i in range(len(t) - length + 1):
                first[t[i : i + length]] = min(d, first.get(t[i : i + length], d))
    out = []
    for d, t in docs:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if d is not None and first[t[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def passages(length):
    rng = random.Random(length)
    line = "".join(rng.choice("abcdé ") for _ in range(140))
    docs = [(i, "".join(rng.choice("xyzü ") for _ in range(rng.randint(0, 200))) + line[rng.randint(0, 60) : rng.randint(60, 140)] + "q" * rng.randint(0, 120)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, docs[3][1]), (103, "ab" * 200), (104, "ab" * 90), (105, "a" * length), (5, docs[5][1]), (None, docs[7][1])]
    once = "".join(rng.choice("uvwxyz") for _ in range(264))
    # Texts under one id: only what a smaller id holds goes, from the row that holds it.
    return [*docs, (200, once), (201, once), (201, once[::-1]), (202, once[:130] + line[:30]), (202, None), (202, "")]


@pytest.mark.parametrize(("length", "many"), [(50, 256), (50, 2), (20, 256), (100, 256), (100, 2), (7, 2)])
def test_removed(spark, monkeypatch, length, many):
    """With ``many`` 2 every shared anchor is split as a common one."""
    monkeypatch.setattr(suffixarray, "MANY", many)
    monkeypatch.setattr(suffixarray, "SHARES", many)
    docs = passages(length)
    got = suffixarray.removed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length)
    assert sorted(map(tuple, got.drop("kept_text", "spans").collect()), key=str) == brute_removed([(d, (t or "").encode()) for d, t in docs], length)


def test_removed_of_nothing_and_of_a_long_text(spark):
    assert suffixarray.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert suffixarray.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    docs = [(1, long), (2, "x" + long[700_000:700_200] + "y"), (3, long[5:])]
    got = {r.doc_id: r.n_removed for r in suffixarray.removed(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 200, 3: len(long) - 5}


def test_window_buckets():
    """Equal numbers if and only if the windows are equal, for every place of the anchor."""
    rng = np.random.default_rng(1)
    for side in (0, 1, 3, 9, 24):
        around = rng.integers(97, 99, (300, 2 * side), dtype=np.uint8)
        anchor = rng.integers(0, 3, 300)
        seen = list(suffixarray.window_buckets(anchor, around, 0, side))
        assert [r for r, _ in seen] == list(range(side + 1))
        for r, bucket in seen:
            want = [(int(a), x[r : side + r].tobytes()) for a, x in zip(anchor, around, strict=True)]
            assert len(set(zip(want, bucket.tolist(), strict=True))) == len(set(want)) == len(set(bucket.tolist()))


@pytest.mark.parametrize("name", ["size", "spans", "n_bytes", "kept_text", "_of", "_null", "Row", "th", "a b"])
def test_without_repeats_keeps_columns(spark, name):
    passage = "word " * 60
    docs = spark.createDataFrame([(1, passage + "é one", 1, "x"), (2, "è" + passage + "ê two", 2, "y"), (3, None, 3, "z")], f"doc_id long, text string, n_chars long, `{name}` string")
    left = suffixarray.without_repeats(docs, 100)
    assert left.columns == docs.columns
    got = {r.doc_id: r for r in left.collect()}
    assert got[1].text == passage + "é one" and got[3].text is None and got[3][3] == "z"
    # The first byte of the last letters is shared, the letters are not: they stay whole.
    assert got[2].text == "èê two" and got[2].n_chars == 6


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60) | st.text("ab", max_size=60).map(str.encode))
def test_suffix_array(text):
    assert list(suffixarray.suffix_array(text)) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aB é\n", max_size=20), max_size=6))
def test_words(texts):
    import pyarrow as pa

    for i, j, data, offsets in kernels.slices(pa.array(texts, pa.string()), 16):
        starts, ends, doc = kernels.words(data, offsets, kernels.SPACE)
        got = [[] for _ in range(j - i)]
        for a, b, d in zip(starts, ends, doc, strict=True):
            got[d].append(data[a:b].tobytes().decode())
        assert got == [t.split() for t in texts[i:j]]
