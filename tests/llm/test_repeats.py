import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import repeats as R


def brute(rows, window):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i : i + window] for _, x in data for i in range(len(x) - window + 1))
    out = []
    for doc, x in data:
        gone = np.zeros(len(x) + 2, bool)
        for i in range(len(x) - window + 1):
            if seen[x[i : i + window]] > 1:
                gone[i + 1 : i + window + 1] = True
        kept = bytes(b for b, g in zip(x, gone[1:-1]) if not g)
        spans = int((np.diff(gone.astype(int)) == 1).sum())
        out.append((doc, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=0, max_size=600), st.sampled_from([64, 70, 100]))
def test_each_window_belongs_to_its_leftmost_least_hash(data, window):
    data = bytes(b % 3 for b in data)
    if len(data) < window:
        return
    h = R.gram_hashes(np.frombuffer(data, np.uint8))
    assert len(h) == len(data) - R.GRAM + 1
    want = [s + int(h[s : s + window - R.GRAM + 1].argmin()) for s in range(len(data) - window + 1)]
    got = [p for p, a, b in R.runs(h, window) for _ in range(a, b + 1)]
    assert got == want


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefé \n") for _ in range(n))
    passages = [text(n) for n in (390, 399, 400, 401, 450, 1200)]
    rows = [(None, None), (0, ""), (1, "x" * 399), (2, "y" * 401), (3, "ab" * 500)]
    for i in range(40):
        parts = [text(rng.randrange(300))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [p[: a if rng.random() < 0.5 else len(p)], text(rng.randrange(200))]
        rows.append((10 + i, "".join(parts)))
    base = text(3000)
    for i in range(6):
        k = rng.randrange(3000)
        rows.append((100 + i, base[:k] + "!" + base[k:]))
    return rows + [(10, rows[5][1]), (12, rows[7][1]), (12, rows[7][1]), (None, base)]


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, first int").repartition(3)
        got = sorted(map(tuple, R.without_repeats(docs).collect()), key=str)
        assert got == brute(rows, R.WINDOW)


def test_one_letter_long_texts_and_a_passage_of_a_third(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passage, long = text(700), text(60_000)
    rows = [(0, "a" * 6_000), (1, "a" * 405), (2, "ab" * 2_500), (3, long), (4, text(500) + long[20_000:20_450] + text(500))]
    rows += [(10 + i, text(rng.randrange(50, 400)) + (passage if i % 3 == 0 else text(700)) + text(300)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, R.without_repeats(docs).collect()), key=str)
    assert got == brute(rows, R.WINDOW)
    by = {r[0]: r for r in got}
    assert all((by[10 + i][2] >= 700) == (i % 3 == 0) for i in range(90))


def test_passages_of_fifty_words_may_be_shorter_than_the_window(spark):
    """A passage of over 50 words that is no 400 bytes long stays, as strings of 400 bytes are what counts."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    say = lambda n: " ".join(word() for _ in range(n))
    short, long = say(60), say(80)  # 359 and 479 bytes
    rows = [(i, f"{say(40)} {short if i < 5 else long} {say(40)}") for i in range(10)]
    got = {r["doc_id"]: r["n_removed"] for r in R.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(5)) and all(got[i] >= 479 for i in range(5, 10))


def test_empty_table(spark):
    assert R.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
