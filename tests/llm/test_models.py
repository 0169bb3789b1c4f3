"""Classifiers, language model, tokenizer, extraction, chat and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tracewright.llm import brown, chat, html, pieces, quality, queries, toxicity

BAD = ["awful", "nasty"]


def labelled(n=240):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            w[rng.randrange(len(w))] = rng.choice(BAD)
        docs.append((i, " ".join(w)))
        labels.append((i, int(not toxic), int(toxic)))
    return docs, labels


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_holds_out(spark):
    docs, labels = labelled()
    rows = toxicity.classify(*tables(spark, docs, labels)).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled()
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    one, two = (sorted(map(tuple, toxicity.classify(*tables(spark, docs, x)).collect())) for x in (labels, flipped))
    assert one == two


def test_classifier_edge_cases(spark):
    docs = [(1, None), (2, ""), (None, "x"), (3, "w1 awful"), (3, "w1 awful"), (4, "??? !!!")]
    d, none = tables(spark, docs, [])
    for op in (toxicity, quality):
        rows = op.classify(d, none).collect()
        assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
        empty = spark.createDataFrame([], "doc_id long, text string")
        assert op.classify(empty, none).count() == 0
    _, labels = tables(spark, docs, [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9, 1, 0), (4, None, None)])
    assert toxicity.classify(d, labels).count() == len(docs)


def test_toxicity_clean_keeps_columns(spark):
    docs, labels = labelled()
    d, y = tables(spark, docs, labels)
    left = toxicity.clean(d.withColumns({"score": F.lit(9), "_text": F.lit("a"), "row": F.lit(1), "a b": F.lit(2)}), y)
    assert left.columns == ["doc_id", "text", "score", "_text", "row", "a b"]
    kept = {r.doc_id for r in left.collect()}
    assert not any(i % 4 == 0 for i in kept) and len(kept) == 180
    assert toxicity.clean(d.withColumn("Score", F.lit(9)), y).columns == ["doc_id", "text", "Score"]
    assert toxicity.clean(d.limit(0), y).count() == 0


def test_unlike_labels(spark):
    """Of unlike labels the smaller counts, whatever the order of the rows."""
    docs, labels = labelled()
    twice = [*labels, *((i, 1 - q, 1 - t) for i, q, t in labels if i % 8 == 1)]
    least = [(i, 0, 0) if i % 8 == 1 else (i, q, t) for i, q, t in labels]
    for op in (toxicity, quality):
        one, two, three = (sorted(map(tuple, op.classify(*tables(spark, docs, x)).collect())) for x in (twice, twice[::-1], least))
        assert one == two == three


def test_long_text(spark):
    """A text of some megabytes between short ones gets a score, and the short ones keep theirs."""
    docs, labels = labelled()
    d, y = tables(spark, docs, labels)
    more, _ = tables(spark, [*docs, (5000, "awful w1 w2 " * 200_000)], labels)
    for op in (toxicity, quality):
        short = {r.doc_id: r.score for r in op.classify(d, y).collect()}
        both = {r.doc_id: r.score for r in op.classify(more, y).collect()}
        assert {k: v for k, v in both.items() if k != 5000} == pytest.approx(short)
        assert 0 <= both[5000] <= 1


def test_ftrl_equals_the_update_by_hand(monkeypatch):
    """Each coordinate's own rate and soft threshold, one feature at a time."""
    monkeypatch.setattr(toxicity, "L1", 0.5)
    rng = random.Random(9)
    x = [sorted(rng.sample(range(40), rng.randint(1, 8))) for _ in range(60)]
    y = [int(3 in e or rng.random() < 0.2) for e in x]
    z, n, bz, bn = [0.0] * 64, [0.0] * 64, 0.0, 0.0
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((b + math.sqrt(n[k])) / a + l2)

    order = np.random.default_rng(7)
    for _ in range(2):
        for k in order.permutation(len(x)):
            w = {i: weight(i) for i in x[k]}
            bias = -bz / ((b + math.sqrt(bn)) / a)
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y[k]
            for i in x[k]:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w[i]
                n[i] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / a * bias
            bn += g * g
    at, got, bias = toxicity.ftrl([np.array(e) for e in x], y, bits=6, epochs=2)
    assert list(at) == [i for i in range(64) if abs(z[i]) > l1]
    assert list(got) == pytest.approx([weight(i) for i in at])
    assert bias == pytest.approx(-bz / ((b + math.sqrt(bn)) / a))


def test_bradley_terry_ranks_and_cuts():
    """Better ones score higher, the loss is near its least value, and no other quantile divides the labels better."""
    rng = np.random.default_rng(3)
    y = (rng.random(300) < 0.4).astype(int)
    x = rng.normal(size=(300, 4)) + np.outer(y, [2.0, 0.0, -1.0, 0.0])
    w, cut, scale = quality.bradley_terry(x, y)
    s = x @ w
    assert w[0] > 0 > w[2] and scale > 0
    right = lambda c: (s[y == 1] >= c).mean() + (s[y == 0] < c).mean()
    assert right(cut) >= max(right(c) for c in s) - 0.02
    good, bad = s[y == 1], s[y == 0]

    def loss(v):
        d = (x[y == 1] @ v)[:, None] - (x[y == 0] @ v)[None, :]
        return np.log1p(np.exp(-d)).mean() + quality.RIDGE / 2 * ((v * (x.std(0) + 1e-6)) ** 2).sum()

    assert (good[:, None] > bad[None, :]).mean() > 0.9
    for k in range(4):  # a step in any direction does not help
        for step in (-0.2, 0.2):
            assert loss(w + step * np.eye(4)[k]) > loss(w) - 2e-3


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    x = [np.unique(np.r_[rng.integers(10, 5000, 30), 3 if i % 2 else 4]) for i in range(200)]
    at, w, _ = toxicity.ftrl(x, [i % 2 for i in range(200)], bits=13)
    assert {3, 4} <= set(at) and len(at) < 60
    assert w[list(at).index(3)] > 0 > w[list(at).index(4)]


def test_quality_separates_junk(spark):
    docs, labels = [], []
    for i in range(200):
        w = [f"word{random.Random(i * 99 + k).randint(0, 500)}" for k in range(30)]
        bad = i % 5 == 0
        docs.append((i, " ".join(x + "###" for x in w) if bad else " ".join(w) + "."))
        labels.append((i, int(not bad), 0))
    rows = quality.classify(*tables(spark, docs, labels)).collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.predicted == (r.doc_id % 5 != 0) for r in held)


def tokens(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", folded), None]


@pytest.mark.parametrize("frequent", [10, 10_000])
def test_base_score(spark, monkeypatch, frequent):
    monkeypatch.setattr(brown, "FREQUENT", frequent)
    monkeypatch.setattr(brown, "M", 8)
    docs = [(i, t) for i, t in labelled()[0]] + [(900, None), (901, ""), (902, "Unseen UNSEEN é"), (903, "W1 w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.doc_id: r for r in brown.score(d, F.col("doc_id") % 10 != 2).collect()}
    c = Counter(t for i, x in docs if i % 10 != 2 for t in tokens(x))
    n, v = sum(c.values()), len(c)
    for i, x in docs:
        r, w = rows[i], tokens(x)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[t] > 0 for t in w), n)


def test_class_model_is_a_distribution_and_beats_the_base(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice("abcdefgh" if i % 2 else "stuvwxyz") * 2 for _ in range(30))) for i in range(200)]
    d = spark.createDataFrame([*docs, *((1000 + k, t) for k, t in enumerate(["aa", "ss", ""]))], "doc_id long, text string")
    out = brown.score(d, F.col("doc_id") % 10 != 0)
    p = brown.perplexity(out.where("doc_id % 10 = 0 and doc_id < 1000")).first()
    assert p.perplexity < 0.7 * p.base_perplexity
    assert all(r.score < 0 for r in out.collect())
    assert brown.score(spark.createDataFrame([(1, "x")], "doc_id long, text string"), F.lit(False)).count() == 1
    assert brown.score(d.limit(0), F.lit(True)).count() == 0


def test_more_equal_words_than_may_be_frequent(spark, monkeypatch):
    """Every word once: some are frequent nonetheless, and all are counted."""
    monkeypatch.setattr(brown, "FREQUENT", 10)
    monkeypatch.setattr(brown, "M", 4)
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(20)], "doc_id long, text string")
    rows = brown.score(docs, F.lit(True)).collect()
    want = 3 * math.log10(1.1 / (80 + 0.1 * 62)) + math.log10(20.1 / (80 + 0.1 * 62))
    assert all(r.base_score == pytest.approx(want) and r.n_known == 4 and r.score < 0 for r in rows)


@pytest.mark.parametrize("frequent", [10, 10_000])
def test_rare_words_have_the_class_of_their_neighbours(spark, monkeypatch, frequent):
    monkeypatch.setattr(brown, "FREQUENT", frequent)
    monkeypatch.setattr(brown, "M", 8)
    rng = random.Random(3)
    a, b = ([f"xy{rng.randrange(10**9)}z" for _ in range(60)] for _ in range(2))
    docs = [(i, " ".join(f"aa {rng.choice([*a, *['a1', 'a2'] * 20])} cc bb {rng.choice([*b, *['b1', 'b2'] * 20])} dd" for _ in range(20))) for i in range(60)]
    tests = [(1000 + i, f"aa {x} cc bb {y} dd") for i, (x, y) in enumerate(zip(a, b))] + [(2000 + i, f"aa {y} cc bb {x} dd") for i, (x, y) in enumerate(zip(a, b))]
    out = {r.doc_id: r.score for r in brown.score(spark.createDataFrame(docs + tests, "doc_id long, text string"), F.col("doc_id") < 1000).collect()}
    assert all(out[1000 + i] > out[2000 + i] + 1 for i in range(60))


def test_probabilities_sum_to_one():
    """Over classes after each class, and over a class's words with the share of the unseen."""
    rng = np.random.default_rng(2)
    table = rng.integers(0, 9, (7, 7)).astype(float)
    table[3] = 0
    assert brown.transitions_of(table).sum(1) == pytest.approx(np.ones(7))
    counts = rng.integers(1, 50, 20)
    assert ((counts + brown.ADD) / (counts.sum() + brown.ADD * 21)).sum() + brown.ADD / (counts.sum() + brown.ADD * 21) == pytest.approx(1)


def test_score_equals_the_model_by_hand(spark):
    """Bigrams, exchange, class sums and every text's probability, counted with dictionaries."""
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["aa bb", "cc dd", "ee", "ff gg hh", "ii"]) for _ in range(rng.randint(1, 25)))) for i in range(40)]
    tests = [(100, "aa bb zz"), (101, ""), (102, None), (103, "hh aa qq ii ii")]
    rows = {r.doc_id: r.score for r in brown.score(spark.createDataFrame(docs + tests, "doc_id long, text string"), F.col("doc_id") < 100).collect()}
    c = Counter(t for _, x in docs for t in tokens(x))
    code = lambda w: int(brown.tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1][0])
    order = sorted((w for w in c if w is not None), key=lambda w: (-c[w], code(w)))
    number = {w: k for k, w in enumerate(order)} | {None: len(order) + 1}
    pairs = np.zeros((len(order) + 2, len(order) + 2))
    for _, x in docs:
        w = [None, *tokens(x)]
        for a, b in zip(w, w[1:], strict=False):
            pairs[number[a], number[b]] += 1
    units = brown.exchange(pairs)
    k = int(units.max()) + 1
    cls = {w: int(units[number[w]]) for w in c}
    size, kinds = np.zeros(k), np.zeros(k)
    for w in c:
        size[cls[w]] += c[w]
        kinds[cls[w]] += 1
    once = np.bincount([cls[w] for w in order if c[w] == 1], minlength=k)
    other = int(once[1:].argmax()) + 1
    table = np.zeros((k, k))
    for _, x in docs:
        w = [0, *(cls[t] for t in tokens(x))]
        for a, b in zip(w, w[1:], strict=False):
            table[a, b] += 1
    follow = brown.transitions_of(table)
    for i, x in docs + tests:
        total, before = 0.0, 0
        for t in tokens(x):
            own = cls.get(t, other)
            total += math.log10(follow[before, own] * (c[t] + brown.ADD) / (size[own] + brown.ADD * (kinds[own] + 1)))
            before = own
        assert rows[i] == pytest.approx(total)


def test_exchange_finds_groups():
    counts = np.zeros((9, 9))
    for a in range(4):
        for b in range(4):
            counts[a, b] = counts[a + 4, b + 4] = 5
    counts[8, :8] = counts[:8, 8] = 1
    cls = brown.exchange(counts, 3)
    assert len({*cls[:4]}) == 1 and len({*cls[4:8]}) == 1 and len({*cls}) == 3


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load(queries.TOKENIZER)


def best_score(p, text):
    """By exhaustive dynamic programming over a dictionary."""
    known = {}
    for i, s in zip(p.ids.tolist(), p.scores.tolist(), strict=True):
        known[p.span[p.span_at[i] : p.span_at[i] + p.span_len[i]].tobytes().decode("utf-8", "replace")] = s
    best = [0.0] + [-math.inf] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(i + 50, len(text)) + 1):
            if text[i:j] in known:
                best[j] = max(best[j], best[i] + known[text[i:j]])
        if text[i] not in known:
            best[i + 1] = max(best[i + 1], best[i] + p.unknown)
    return best[-1]


def test_viterbi_is_optimal(vocabulary):
    p = vocabulary
    value = dict(zip(p.ids.tolist(), p.scores.tolist(), strict=True))
    for word in [" the", "  tokenization", " überraschung", " 한글x", " zzqx😀", "internationalization", " \n\n\t"]:
        marked = word.replace(" ", pieces.MARK).encode()
        ids = p.one(marked)
        assert np.array(ids, np.int32).tobytes() == p.many([marked, b"x", marked])[0]
        score = 0.0
        back, cuts = p.decode(np.array(ids), np.array([0, len(ids)]))
        full = p.span[np.concatenate([np.arange(p.span_at[i], p.span_at[i] + p.span_len[i]) for i in ids])].tobytes().decode()
        assert full == word
        for i in ids:
            score += value.get(i, 0.0)
        chars = [c for c in word if not any(c == p.span[p.span_at[i] : p.span_at[i] + p.span_len[i]].tobytes().decode("utf-8", "replace") for i in value)]
        assert score + len(chars) * p.unknown == pytest.approx(best_score(p, word))


def test_round_trip(spark, vocabulary):
    texts = ["", None, " ", "a", " a  b ", "▁", "a▁ ▁b", "한글\n\tTab", "😀" * 40, "x" * 3000, "long " * 2000, "\u0000​"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pieces.encoded(d, vocabulary, decoded=True)
    assert all(r.round_trip for r in out.collect())
    assert {r.doc_id: r.text for r in pieces.decode(out, vocabulary).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encoded(d.limit(0), vocabulary).count() == 0


def test_decode_of_any_ids(spark, vocabulary):
    """Only a marker's space goes; ids that the vocabulary lacks become U+FFFD, lists that are null the empty text."""
    word = next(int(i) for i in vocabulary.ids if vocabulary.span_len[i] == 2 and vocabulary.span[vocabulary.span_at[i]] != 0x20)
    text = vocabulary.span[vocabulary.span_at[word] :][:2].tobytes().decode()
    rows = spark.createDataFrame([(1, [word]), (2, [10**6, word, -5]), (3, None), (4, []), (5, [None, word])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in pieces.decode(rows, vocabulary).collect()}
    assert got == {1: text, 2: f"\ufffd{text}\ufffd", 3: "", 4: "", 5: f"\ufffd{text}"}


def test_encoded_keeps_columns(spark, vocabulary):
    d = spark.createDataFrame([(1, "a b", 7, "x", 2.5), (2, None, 8, None, 1.5)], "doc_id long, text string, n_tokens int, `a b` string, row double")
    out = pieces.encoded(d, vocabulary, decoded=True)
    assert out.columns == ["doc_id", "text", "a b", "row", "n_tokens", "n_byte_tokens", "ids", "round_trip"]
    assert sorted((r.doc_id, r.text, r["a b"], r.row) for r in out.collect()) == [(1, "a b", "x", 2.5), (2, "", None, 1.5)]


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"b", "é".encode(), b"\xff"]
    t = pieces.DoubleArray(keys)
    for k, key in enumerate(keys):
        node = 0
        for b in key:
            go = t.base[node] + b + 1
            assert t.check[go] == node
            node = go
        assert t.value[node] == k


@pytest.fixture(scope="module")
def page_model():
    return html.learn()


def test_html_labelled_pages(page_model):
    for page in html.labelled():
        want = " ".join(" ".join(re.sub("<[^>]*>", "", x) for x in re.findall(r"\{([^}]*)\}", page)).split())
        assert html.extract(re.sub("[{}]", "", page), page_model) == want


LONG = "The main text of this page stands in a plain element without any paragraph, and goes on for a while. It has two sentences."
PAGES = [
    (f"<body><div><a>x</a> <a>y</a></div><div>{LONG}</div></body>", LONG),
    (f"<body><div><a href='/'>Home</a> | <a>Log in</a></div><table><tr><td>{LONG}</td></tr><tr><td>{LONG}</td></tr></table><div><a>Imprint</a></div></body>", f"{LONG} {LONG}"),
    ("<article><p>One sentence stands here.</p><div class='menu-prices'><p>Soup costs three and bread two.</p></div><p>End.</p></article>", "One sentence stands here. Soup costs three and bread two. End."),
    ("<article><p>wo<script>x('</p>')</script>rd and wo<!-- <p>no</p> -->rd</p></article>", "word and word"),
    ("<article><p>a<b>b</b>&nbsp;c<br>d</p><p>e &lt;f&gt;</p></article>", "ab c d e <f>"),
    (f"<body><main><h1>T</h1><p>Short one.</p><div class='ad'>{'buy now ' * 400}</div><p>The end of it.</p></main><section class='comments'><p>{'I say ' * 300}</p></section></body>", "T Short one. The end of it."),
    (f"<body><div class='content'><p>{'word ' * 50}</p><div class='newsletter-signup'>{'sign up ' * 200}</div><p>tail text here.</p></div><div id='sidebar'>{LONG}</div></body>", "word " * 50 + "tail text here."),
    (f"<div><p>{LONG}</p><aside>{LONG}</aside><p>{LONG}</p></div><footer>{LONG}</footer>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}</p><section class='comment-section'><p>{LONG}</p></section><div class='post-footer'>Filed under trees</div></article>", LONG),
    (f"<article><p>{LONG}<p>No end tags<ul><li>one<li>two</ul><form><p>Name</form></article>", f"{LONG} No end tags one two"),
    (f"<body><div class='wrapper'><div class='header'>Site title and <a>links</a></div><div class='content'><div class='entry-header'><h2>Title</h2></div><p>{LONG}</p></div><div class='footer'>{LONG}</div></div></body>", f"Title {LONG}"),
    (f"<body><div id='header'><h1>My site</h1></div><div id='main'><h2>Title</h2><p>{LONG}</p><div id='respond'><h3>Leave a reply</h3><form><textarea>x</textarea></form></div></div><div id='feedback'>{LONG}</div></body>", f"Title {LONG}"),
    ("<nav>x</nav>", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_html_layouts(page_model, page, want):
    assert html.extract(page, page_model) == want


def test_html_deep_pages_take_linear_time(page_model):
    import time

    def took(n):
        began = time.process_time()
        for page in ("<div>" * n + LONG, "<b><p>x" * n, "<div>" + "<b>" * n + "</i><p>x</p>" * n):
            html.extract(page, page_model)
        return time.process_time() - began

    took(500)
    assert took(16_000) < 16 * max(took(2_000), 0.02)
    long = f"<article>{f'<p>{LONG}</p>' * 20_000}</article>"
    assert html.extract(long, page_model) == " ".join([LONG] * 20_000)


def brute_run(scores):
    best = max(((sum(scores[i:j]), -i, -(j - i)) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=(0, 0, 0))
    return best[0]


def test_html_run_is_the_best_one(page_model):
    """The chosen stretches' sum equals the best of all contiguous runs."""
    rng = random.Random(8)
    for _ in range(30):
        parts = [rng.choice([f"<p>w{k} x y</p>", f"<div><a>l{k}</a></div>", f"<span>s{k}</span>"]) for k in range(rng.randint(1, 12))]
        scores, best, span = html.scan(html.scored("".join(parts), page_model))
        assert best == pytest.approx(max(0.0, brute_run(scores)))
        assert best == pytest.approx(sum(scores[span[0] : span[1]]))


def test_html_edge_cases(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, None, "<p>one &amp; two"), (4, "u", "<nav>x</nav>"), (5, "u", "<article><p>a<b>b</b>&nbsp;c</p><!-- <p>no</p> --><script>var x='<p>no</p>'</script><p>d</article>"), (5, "u", "plain < text words only here")]
    rows = html.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    got = [(r.page_id, r.text, r.n_chars) for r in rows]
    assert got[:5] == [(1, "", 0), (2, "", 0), (3, "one & two", 9), (4, "", 0), (5, "ab c d", 6)]
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_articles(spark):
    import html as lib

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in html.extracted(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))
        assert got[r.page_id] == " ".join(lib.unescape(body).split())


def test_chat_roles(spark):
    d = spark.read.parquet(f"{SF}/conversations.parquet")
    model = chat.train(d)
    got = chat.recovered(d, model)
    truth = d.select("conv_id", "turn", F.col("role").alias("truth"))
    joined = got.join(truth, ["conv_id", "turn"])
    assert joined.count() == d.count()
    assert joined.where("role = truth").count() >= 0.97 * d.count()


def test_long_conversations_are_cut_without_loss(spark, monkeypatch):
    rng = random.Random(4)
    turns = [(1, k, "user" if k % 2 else "assistant", "x" * rng.randint(1, 900)) for k in range(40)] + [(2, 0, "system", "hi"), (2, 1, "user", None), (None, 3, "user", "q?"), (3, None, None, "t"), (2, 1, "user", "again")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    model = chat.train(d)
    whole = sorted(map(str, chat.recovered(d, model).collect()))
    monkeypatch.setattr(chat, "CHUNK", 7)
    assert sorted(map(str, chat.recovered(d, model).collect())) == whole
    assert len(whole) == len(turns)
    assert chat.recovered(d.limit(0), model).count() == 0


def brute_path(model, seen):
    import itertools

    best = max(itertools.product(range(3), repeat=len(seen)), key=lambda p: (model["start"][p[0]] + sum(model["move"][a, b] for a, b in zip(p, p[1:], strict=False)) + sum(model["seen"][s, o] for s, o in zip(p, seen, strict=True))))
    return list(best)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    for _ in range(40):
        model = {k: np.log(rng.dirichlet(np.ones(n), size)) for k, n, size in (("start", 3, None), ("move", 3, 3), ("seen", 6, 3))}
        seen = rng.integers(0, 6, rng.integers(1, 8)).tolist()
        assert chat.viterbi(model, seen, model["start"]) == brute_path(model, seen)


def test_roles_of_held_out_conversations(spark):
    """Learnt from four fifths of the conversations, looked up in the others."""
    d = spark.read.parquet(f"{SF}/conversations.parquet")
    held = F.crc32(F.col("conv_id").cast("string")) % 5 == 0
    got = chat.recovered(d, chat.train(d, ~held)).where(held)
    joined = got.join(d.select("conv_id", "turn", F.col("role").alias("truth")), ["conv_id", "turn"])
    assert joined.count() > 0 and joined.where("role = truth").count() >= 0.95 * joined.count()


def test_many_rows_without_a_turn(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 8)
    rows = [(1, None, f"t{i % 3}?") for i in range(300)] + [(1, -5, "first"), (1, 2, "last"), (2, None, None), (2, -1, "a")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    model = chat.train(spark.read.parquet(f"{SF}/conversations.parquet"))
    out = chat.recovered(d, model).collect()
    assert sorted((r.conv_id, r.turn, r.text) for r in out if r.turn is not None) == [(1, -5, "first"), (1, 2, "last"), (2, -1, "a")]
    assert Counter((r.conv_id, r.text) for r in out) == Counter((c, t) for c, _, t in rows)


def test_raw_transcripts(spark):
    """Rendered turns in several notations come back with their roles and texts."""
    model = chat.train(spark.read.parquet(f"{SF}/conversations.parquet"))
    raw = [(1, "User: How do I\nsort it?\nAssistant: Call sort.\nUser: Thanks"), (2, "### System\nBe brief.\n### Human\nhi?\n### Assistant\nhello"), (3, None), (4, "no marker at all"), (5, "[user] a\n[assistant] b")]
    rows = chat.from_transcripts(spark.createDataFrame(raw, "conv_id long, text string"), model).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.role) for r in rows if r.conv_id != 4] == [(1, "user"), (1, "assistant"), (1, "user"), (2, "system"), (2, "user"), (2, "assistant"), (5, "user"), (5, "assistant")]
    assert rows[0].rendered == "<|user|>\nHow do I\nsort it?\n<|end|>"
    assert [r.conv_id for r in rows].count(4) == 1


def test_markers_decide(spark):
    d = spark.createDataFrame([(1, 0, "user", "Assistant: hello there"), (1, 1, "user", "User: hi")], "conv_id long, turn long, role string, text string")
    model = chat.train(spark.read.parquet(f"{SF}/conversations.parquet"))
    rows = sorted(chat.recovered(d, model).collect(), key=lambda r: r.turn)
    assert [r.role for r in rows] == ["assistant", "user"]
    assert rows[0].rendered == "<|assistant|>\nhello there\n<|end|>"
    cut = spark.createDataFrame([("User: hi\nthere\nAssistant: hello",)], "t string").select(chat.parse_transcript(F.col("t")).alias("x")).first().x
    assert cut == ["User: hi\nthere", "Assistant: hello"]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_tables(spark, name):
    rows = queries.QUERIES[name](spark, SF).count()
    if not name.startswith("op"):
        return  # held against SQL
    tables = {"op6_html_extraction": "pages", "op7_chat_format": "conversations"}
    assert rows == spark.read.parquet(f"{SF}/{tables.get(name, 'documents')}.parquet").count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id for r in docs.collect()}
        assert after <= before and (name != "suffix_dedup" or after == before)
        before = after
    rows = p.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == before and all(r.round_trip for r in rows)
    assert {"lang", "source", "n_chars", "text", "ids"} <= set(rows[0].asDict())
