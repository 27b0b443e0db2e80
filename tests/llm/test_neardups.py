import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewater.llm import neardups as N


def shingles(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = [(d, len(s), None if d is None else find(d), d is None or find(d) == d) for (d, _), s in zip(rows, sets)]
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(n)]
    rows = [(None, None), (0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three four five"), (None, "one two")]
    at = 10
    for _ in range(12):
        base = words(rng.choice([6, 12, 40, 200, 600]))
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 30))):
                w[rng.randrange(len(w))] = words(1)[0]
            rows.append((at, " ".join(w)))
            at += 1
    hub = words(300)  # copies that are alike to the hub and less so to each other
    for i in range(30):
        w = list(hub)
        for k in range(6 * (i > 0)):
            w[(i * 9 + k * 47) % 300] = f"new{i}-{k}"
        rows.append((500 - i, " ".join(w)))
    rng.shuffle(rows)
    # rows of one doc_id with different texts: one document to their links
    one, two = words(100), words(100)
    rows += [(800, " ".join(one)), (800, " ".join(two)), (801, " ".join(one[:-1])), (802, " ".join(two[1:])), (790, None), (790, " ".join(two[2:])), (791, "")]
    return rows + [(3, "One two"), (7, "x " * 3000), (8, "x " * 3100)]


@pytest.mark.parametrize(("seed", "stars", "block"), [(1, N.STARS, N.BLOCK_CLASSES), (2, 1, 4), (3, 0, 5)])
def test_against_brute_force(spark, monkeypatch, seed, stars, block):
    monkeypatch.setattr(N, "STARS", stars)
    monkeypatch.setattr(N, "BLOCK_CLASSES", block)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, rep int").repartition(3)
    got = sorted(map(tuple, N.near_duplicates(docs).collect()), key=str)
    assert got == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(edges=st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15))
def test_components(spark, edges):
    root = {x: x for e in edges for x in e}
    for _ in edges:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    got = N.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["root"] for r in got.collect()} == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(4)
    for n in (2, 5, 40, 2000):
        hits = []
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, n + n // 4, np.uint64) * np.uint64(2))
            a, b = x[: n], np.concatenate([x[: n - n // 4], x[n:]])
            hits.append((N.signature(np.sort(a)) == N.signature(np.sort(b))).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(hits)) < 0.06


def test_unlike_classes_of_one_bucket_take_linear_work(spark, monkeypatch):
    """Documents that share a passage and little else meet in buckets, and no pair is left."""
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join(passage + [word() for _ in range(60)])) for i in range(3000)]
    rows += [(5000 + i, rows[i][1] + f" end{i}") for i in range(50)]
    left, tested = [], []
    found, pairs, proved = N.left_pairs, N.bounded_pairs, N.verified
    monkeypatch.setattr(N, "left_pairs", lambda *a: left.append(found(*a)) or left[-1])
    monkeypatch.setattr(N, "verified", lambda e, s: tested.append(e.count()) or proved(e, s))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs).collect()}
    assert all(got[i] == (i if i < 5000 else i - 5000) for i, _ in rows)
    assert left[0].count() < 200 and sum(tested) < 2 * N.STARS * N.BANDS * 3050


def test_rare_parts_keep_every_link_together(spark):
    rng = random.Random(7)
    sets = {}
    for i in range(60):
        base = set(rng.sample(range(400), rng.choice([1, 4, 40, 41, 42]))) if i % 3 == 0 or not sets else set(sets[i - 1])
        for _ in range(rng.randrange(4)):
            base ^= {rng.randrange(400)}
        sets[i] = base or {1}
    part = {r["rep"]: r["part"] for r in N.rare_parts(spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "rep long, shingles array<long>")).collect()}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                assert part[i] == part[j]


def test_long_text(spark):
    text = " ".join(f"v{i}" for i in range(300_000))
    got = N.near_duplicates(spark.createDataFrame([(2, text), (1, text + " end"), (3, "a b c d e f")], "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 299_997, 1, True), (2, 299_996, 1, False), (3, 2, 3, True)]


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
