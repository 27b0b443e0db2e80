import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import fingerprint as P


def slow_hash(codes):
    h = 0
    for c in codes:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
    for mul, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        h = ((h ^ h >> shift) * mul) % 2**64
    return h ^ h >> 31


def slow_places(text):
    """Where the least inner hash of a stretch is its first's or its last's."""
    out = []
    for i in range(len(text) - P.SPAN + 1):
        inner = [slow_hash(text[i + j : i + j + P.INNER]) for j in range(P.SPAN - P.INNER + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def prose(rng, words):
    return " ".join("".join(rng.choices("abcdefghé", k=rng.randint(1, 9))) for _ in range(words))


def test_anchors_are_closed_syncmers():
    rng = random.Random(1)
    texts = [prose(rng, n) for n in (0, 1, 3, 5, 20, 60)] + ["aaaa" * 30, "ab" * 40, "x" * P.SPAN, "y" * (P.SPAN - 1), "😀é" * 30]
    for text, got in zip(texts, P.fingerprint_all(texts), strict=True):
        places, hashes = P.anchors(got)
        want = slow_places(text) if len(text) >= P.SPAN or not text else [0]
        assert places.tolist() == want and len(hashes) == len(want)
        assert len(np.diff(places)) == 0 or np.diff(places).max() <= P.SPAN - P.INNER
        assert P.fingerprint_all([text]) == [got]


def test_chunks_change_nothing(monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(60)]
    whole = P.fingerprint_all(texts)
    monkeypatch.setattr(P, "CHUNK", 100)
    assert P.fingerprint_all(texts) == whole


def test_anchors_are_free_of_context():
    rng = random.Random(3)
    passage = prose(rng, 60)
    (alone,) = P.fingerprint_all([passage])
    (inside,) = P.fingerprint_all([prose(rng, 40) + passage + prose(rng, 40)])
    places, hashes = P.anchors(alone)
    assert set(hashes.tolist()) <= set(P.anchors(inside)[1].tolist()) and len(places) > 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_likeness_is_the_longest_common_order(a, b):
    def printed(hashes):
        import base64

        e = np.empty(len(hashes), P._ENTRY)
        e["gap"], e["hash"] = 1, hashes
        return base64.b64encode(e.tobytes()).decode()

    # occurrences are paired by their number, so with repeats the chain is a lower bound of the LCS
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    got, most = P.likeness(printed(a), printed(b)), table[-1, -1]
    assert got == P.likeness(printed(b), printed(a)) and 0 <= got <= 1
    if a != b and a and b:
        assert got <= 2 * most / (len(a) + len(b)) + 1e-12
        if len(set(a)) == len(a) and len(set(b)) == len(b):
            assert got == 2 * most / (len(a) + len(b))


def brute(rows, ties):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1] or ""]))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new, nxt = P.fingerprint_all([text, edited, after])
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, P.likeness(own, new), P.likeness(own, nxt)))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 5])
def test_compared_with_the_next(spark, monkeypatch, partitions):
    rng = random.Random(4)
    monkeypatch.setattr(P, "RANGE_CHARS", 2000)
    rows = [(i * 7 % 101, prose(rng, rng.randint(0, 60))) for i in range(101)]
    rows += [(200, None), (201, ""), (202, "short"), (203, prose(rng, 20_000)), (None, "no id"), (None, "none either"), (50, "a second text"), rows[3], rows[3]]
    docs = spark.createDataFrame([(*r, "clash", True) for r in rows], "doc_id long, text string, range string, extra boolean")
    ties = {r["t"]: r["x"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t").alias("x")).collect()}
    got = P.compared(docs.repartition(partitions)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, ties)
    prints = {r["doc_id"]: r["fingerprint"] for r in P.fingerprints(docs).collect()}
    assert all(prints[r["doc_id"]] == r["fingerprint"] for r in got if r["doc_id"] in (200, 201, 202, 203))


def test_few_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.compared(docs).collect() == []
    (one,) = P.compared(spark.createDataFrame([(1, "one document alone, which follows itself")], docs.schema)).collect()
    assert one["near_next"] == 1.0 and one["n_chars"] == 40


def test_halves_are_found_and_next_documents_are_not(spark):
    got = P.op12_fingerprints(spark, "/root/testdata/sf0.001").toPandas()
    long = got[got.n_chars >= 200]
    assert (long.near_edited > 0.3).all() and long.near_edited.median() > 0.45
    assert (long.near_next < 0.2).mean() > 0.97 and len(long) > 150
    same = got.groupby("fingerprint").n_chars.nunique()
    assert (same == 1).all()
