"""Decontamination and order MinHash against brute force, and that they run no Python on executors."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tracewright.llm import decontam, orderminhash, queries

SCHEMA = "doc_id long, text string, source string"


def words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = words(t)
        if w and i is not None:
            for k in range(max(len(w) - size + 1, 1)):
                windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t, _ in docs:
        w, hit, found = words(t), set(), set()
        for win, of in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= of
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, size=10):
    d = spark.createDataFrame(docs, SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string, doc_id string")if items and len(items[0]) == 3 else spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.decontaminate(d, b, size).collect()
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows], key=str)


def test_op3_equals_sql(agree):
    agree(queries.QUERIES["op3_decontamination"], queries.OP3_SQL)


def test_edge_cases(spark):
    p = "Alpha beta gamma DELTA epsilon zeta eta theta iota kappa lambda mu"
    docs = [(1, f"x, {p.lower()}! y {p}", "s"), (2, None, None), (3, "", "s"), (4, "short one", "s"), (None, p, "s"), (5, "the " * 50 + p, "s"), (5, "the " * 50 + p, "s"), (6, "École " + p + " é", "s"), (7, p.replace("gamma", "other"), "s")]
    items = [(1, p), (2, "Short ONE"), (3, None), (4, ""), (5, "?!"), (None, p), (10, p + " nu"), (2, "école alpha")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    (row,) = run(spark, [(1, "a b c", "s")], [])
    assert row == (1, 3, 0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_repeated_terms(spark):
    docs = [(i, " ".join("ab"[(i >> k) & 1] for k in range(9)), "s") for i in range(60)]
    items = [(1, "a a b"), (2, "b b b b"), (3, "a b a b")]
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two x three four"), (2, "one two y z w three four"), (3, "four three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert {r.doc_id for r in decontam.matches(docs, items, 4, slop=1).collect()} == {1}
    assert decontam.matches(docs, items, 4).count() == 0


def test_clean_keeps_the_others_whole(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, 1), (2, "x y", 8, 2), (3, None, 9, 3)], "doc_id long, text string, phrase int, _hit_id int")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for name in ("phrase", "hit_id", "row", "Hit_Hash", "a b"):
        left = decontam.clean(docs.withColumnRenamed("phrase", name), items)
        assert left.columns == ["doc_id", "text", name, "_hit_id"]
        assert sorted(map(tuple, left.collect())) == [(2, "x y", 8, 2), (3, None, 9, 3)]
    assert decontam.clean(docs.limit(0), items).count() == 0


def test_a_very_long_text(spark):
    docs = [(1, "w x " * 300_000 + "one two three"), (2, "one two three"), (3, "w x y")]
    assert run(spark, [(*d, "s") for d in docs], [(1, "one two three")], 3) == brute([(*d, "s") for d in docs], [(1, "one two three")], 3)


def edited(ids_texts):
    order = sorted(ids_texts, key=lambda x: -x[0])
    out = {}
    for k, (d, t) in enumerate(order):
        n = len(t or "") // 3
        nxt = order[(k + 1) % len(order)][1] or ""
        out[d] = hashlib.sha256(((t or "")[: len(t or "") - n] + nxt[:n]).encode()).hexdigest()
    return out


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_document(spark, buckets):
    docs = [(i * 7 % 101, "é" * (i % 5) + f" w{i} " * i) for i in range(40)] + [(200, None)]
    rows = orderminhash.with_next(spark.createDataFrame(docs, "doc_id long, text string"), buckets)
    assert rows.where("copy = 0").count() == len(docs)
    got = {r.doc_id: r.edited_sha256 for r in orderminhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == edited(docs)


def test_likeness_falls_with_edits(spark):
    base = [f"w{i}" for i in range(300)]
    moved, changed = base[150:] + base[:150], [w if i % 30 else "new" for i, w in enumerate(base)]
    docs = [(4, " ".join(base)), (3, " ".join(base)), (2, " ".join(changed)), (1, "nothing in common with it at all"), (0, " ".join(moved))]
    got = {r.doc_id: r for r in orderminhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[4].near_next == 1.0 and got[4].fingerprint == got[3].fingerprint
    assert 0.2 < got[3].near_next < 1.0
    assert got[2].near_next == 0.0


def test_occurrences_count(spark):
    docs = [(2, "a b c " * 10), (1, "a b c " * 30)]
    rows = orderminhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len({r.fingerprint for r in rows}) == 2


def spark_hash64(*values):
    """The engine's 64-bit hash of a row: each value is the next one's seed, nulls are passed over."""
    import xxhash

    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def spark_hash32(*longs):
    """The engine's 32-bit hash (Murmur3) of longs, as unsigned."""
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF
    h = 42
    for v in longs:
        for part in (v & 0xFFFFFFFF, (v >> 32) & 0xFFFFFFFF):
            k = rotl(part * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
            h = (rotl(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
        h ^= 8
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> shift)) * factor & 0xFFFFFFFF
        h ^= h >> 16
    return h


def brute_fingerprint(text):
    """Numbered k-mers on the circle, one point after the other."""
    w = re.findall(r"[^\x20\x09-\x0D]{1,24}", text or "")
    if not w:
        return "0" * 512
    found, seen = [], {}
    for i in range(max(len(w) - 2, 1)):
        kmer = spark_hash64(*(w[i : i + 3])) >> 24
        seen[kmer] = seen.get(kmer, -1) + 1
        found.append((spark_hash64((kmer, 8), (seen[kmer], 4)) >> 24, i))
    found.sort()
    out = ""
    for point in range(-32, 32):
        at = next((k for k, (h, _) in enumerate(found) if h >> 34 >= point), 0)
        x, y = found[at], found[(at + 1) % len(found)]
        first, second = (x, y) if x[1] <= y[1] else (y, x)
        out += f"{spark_hash32(first[0], second[0]):08x}"
    return out


def test_fingerprints_equal_brute_force(spark):
    import random

    rng = random.Random(12)
    texts = ["", "one", "two words", "a b c a b c a b c", "é ü  ß\t\n x", "x" * 60] + [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(3, 200))) for _ in range(25)]
    docs = list(enumerate(texts))
    rows = {r.doc_id: r for r in orderminhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    like = lambda a, b: 1.0 if a == b else sum(a[k : k + 8] == b[k : k + 8] for k in range(0, 512, 8)) / 64
    for i, t in docs:
        nxt = texts[(i - 1) % len(texts)]
        n = len(t) // 3
        own, changed = brute_fingerprint(t), brute_fingerprint(t[: len(t) - n] + nxt[:n])
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (own, changed)
        assert (rows[i].near_edited, rows[i].near_next) == (like(own, changed), like(own, brute_fingerprint(nxt)))


def test_fingerprint_edge_cases(spark):
    docs = [(1, ""), (2, None), (3, "   "), (4, "one"), (4, "one"), (None, "x"), (None, "y")]
    rows = orderminhash.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 and len(r.fingerprint) == 512 for r in rows)
    assert orderminhash.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert orderminhash.fingerprints(spark.createDataFrame([(1, "abc")], "doc_id long, text string").limit(1)).first().near_next == 1.0


@pytest.mark.parametrize("name", ["op3_decontamination", "op10_order_minhash"])
def test_no_python_on_executors(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab c", max_size=12), min_size=1, max_size=8))
def test_any_texts(spark, texts):
    docs = [(i, t, "s") for i, t in enumerate(texts)]
    items = [(1, "a b"), (2, "c")]
    assert run(spark, docs, items, 2) == brute(docs, items, 2)
