import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import boundaries, infill

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]


def brute(doc_id, text, p=infill.Params()):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = hashlib.sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    pre, mid, suf = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= p.cut:
        return doc_id, len(tokens), "plain", None, None, text
    if h[3] % 100 < p.suffix_first:
        return doc_id, len(tokens), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(tokens), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_lists_give_back_every_number(numbers):
    values = np.array(sorted(numbers), np.int64)
    data = boundaries.encode(values)
    assert boundaries.count(data) == len(values)
    assert [boundaries.select(data, i) for i in range(len(values))] == values.tolist()
    for i in (-1, len(values)):
        with pytest.raises(IndexError):
            boundaries.select(data, i)


def test_lists_are_short_and_long_ones_have_a_directory():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 12, 200_000))
    data = boundaries.encode(ends)
    assert len(data) < 0.7 * len(ends)
    assert [boundaries.select(data, i) for i in range(0, len(ends), 997)] == ends[::997].tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \t\n\r\x0b\x0c\x1f\x85 é😀<P>"))
def test_token_ends(text):
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert infill.token_ends(text.encode()).tolist() == np.cumsum([len(t) for t in tokens]).astype(int).tolist()


def texts():
    rng = random.Random(5)
    words = ["a", "bé", "😀", "\n\n", "\t", "x<", "P>", "<<", "S", ">", "$1", "\\Q", "long" * 9]
    out = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(150)]
    return out + ["", None, " ", "w", "a <P> b", "<S>", "x<M>", "word " * 50_000, "é" * 90_000, "<" * 20, "> <" * 9]


def run(spark, rows, p=infill.Params()):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, form string, key int, part int, parts int").repartition(3)
    found = infill.fill_in_middle(docs, p)
    return found.withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()


@pytest.mark.parametrize("p", [infill.Params(), infill.Params(seed=7, cut=100, suffix_first=0), infill.Params(cut=100, suffix_first=100)])
def test_cuts_and_their_undoing(spark, p):
    given_ = texts()
    rows = [(i, t) for i, t in enumerate(given_)] + [(None, "null id here"), (3, given_[3]), (3, "another text of it"), (500, given_[3])]
    got = run(spark, [(*r, "clash", "clash", 1, 2, 3) for r in rows], p)
    want = [brute(*r, p) for r in rows]
    assert sorted((tuple(r[c] for c in COLUMNS) + (r["output"],) for r in got), key=str) == sorted(want, key=str)
    texts_of = sorted(t or "" for _, t in rows)
    assert sorted(r["again"] for r in got) == texts_of


def test_frequent_texts_are_split_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(infill, "COPIES", 10)
    monkeypatch.setattr(infill, "SHARE", 100)
    rows = [(i, "the same text again" if i % 3 else f"text {i} of its own") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = infill.grouped(docs).collect()
    often = [len(r["doc_ids"]) for r in got if r["text"].startswith("the same")]
    assert sum(often) == 200 and len(often) > 15 and max(often) < 40
    found = infill.fill_in_middle(docs).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) + (r["output"],) for r in found) == sorted((brute(*r) for r in rows), key=lambda r: r[0])


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(infill.F, "xxhash64", lambda *c: F.lit(1))
    rows = [(i, f"text {i % 4} here") for i in range(12)]
    got = infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) + (r["output"],) for r in got) == [brute(*r) for r in rows]


def test_no_documents(spark):
    assert run(spark, []) == []
