"""Renames by likeness against a greedy walk over all pairs."""

import collections
import random

import pytest

from tracewright.operators import ingest


def walk(gone, come, least):
    gone, come, out = dict(gone), dict(come), {}
    for text in sorted({t or "" for t in gone.values()}):
        a, b = (sorted(p for p, t in files.items() if (t or "") == text) for files in (gone, come))
        for x, y in zip(a, b, strict=False):
            out[x] = (y, 1.0)
            del gone[x], come[y]
    weigh = lambda t: collections.Counter((t or "").split("\n"))
    size = lambda c: sum(n * (len(x.encode()) + 1) for x, n in c.items())
    pairs = []
    for x, t in gone.items():
        for y, u in come.items():
            a, b = weigh(t), weigh(u)
            s = size(a & b) / max(size(a), size(b))
            if s >= least:
                pairs.append((-s, x, y))
    used = set()
    for s, x, y in sorted(pairs):
        if x not in out and y not in used:
            out[x] = (y, -s)
            used.add(y)
    return {x: (y, round(s, 9)) for x, (y, s) in out.items()}


@pytest.mark.parametrize(("seed", "least"), [(1, 0.5), (2, 0.8), (3, 0.2)])
def test_renames_equal_a_walk(spark, seed, least):
    rng = random.Random(seed)
    word = lambda: rng.choice(["}", "", "return é", f"line {rng.randint(0, 30)}", f"own {rng.random()}"])
    base = [[word() for _ in range(rng.randint(1, 12))] for _ in range(15)]

    def near(lines):
        return "\n".join(x if rng.random() > 0.25 else word() for x in lines)

    gone = [(f"a{i:02}", near(rng.choice(base))) for i in range(25)] + [("a90", None), ("a91", ""), ("a92", "x\ny"), ("a93", "x\ny")]
    come = [(f"b{i:02}", near(rng.choice(base))) for i in range(25)] + [("b90", ""), ("b92", "x\ny"), ("b93", "}\n" * 40)]
    frames = [spark.createDataFrame(f, "path string, content string") for f in (gone, come)]
    got = ingest.renames(*frames, least).collect()
    assert {r.from_path: (r.path, round(r.likeness, 9)) for r in got} == walk(gone, come, least) and len({r.path for r in got}) == len(got)
    assert ingest.renames(frames[0].limit(0), frames[1]).collect() == []


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_near_copies_do_not_take_a_round_each(spark, monkeypatch, most):
    """Twelve near copies on each side, all equally alike: before, each round took one pair of them."""
    gone = [(f"a{i:02}", "a common line\nand another\n" + f"old {i:02}") for i in range(12)]
    come = [(f"b{i:02}", "a common line\nand another\n" + f"new {i:02}") for i in range(12)]
    rounds = []
    kept = ingest.checkpointed
    monkeypatch.setattr(ingest, "checkpointed", lambda d: (rounds.append(1), kept(d))[1])
    got = ingest.renames(*(spark.createDataFrame(f, "path string, content string") for f in (gone, come)), most=most).collect()
    assert {r.from_path: (r.path, round(r.likeness, 9)) for r in got} == walk(gone, come, 0.5) and len(got) == 12
    assert len(rounds) <= (10 if most > 1000 else 20)
