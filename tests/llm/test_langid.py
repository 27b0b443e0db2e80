import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import langid as L

PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab", "c"]


def by_hand(word, chance, g):
    """Sum over all segmentations, letters alone included."""
    text, total = L.START + word, 0.0
    known = dict(zip(PIECES, chance[:, g]))
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, last = [], 0
        for i, c in enumerate(cuts):
            if c:
                parts.append(text[last : i + 1])
                last = i + 1
        parts.append(text[last:])
        total += math.prod((known.get(p, 0.0) + (L.LETTER if len(p) == 1 else 0.0)) for p in parts)
    return math.log(total)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcd", min_size=5, max_size=5), min_size=1, max_size=5))
def test_forward_sums_all_segmentations(same):
    chance = np.random.default_rng(1).dirichlet(np.ones(len(PIECES)), 2).T
    tree = L.Tree(PIECES)
    by_node = np.zeros((tree.nodes, 2))
    by_node[tree.ends] = chance
    got = tree.forward(tree.matrix(same), by_node)
    for i, w in enumerate(same):
        for g in range(2):
            assert abs(got[i, g] - by_hand(w, chance, g)) < 1e-9


def test_long_words_do_not_vanish_and_both_trees_agree(monkeypatch):
    tree = L.Tree(PIECES)
    by_node = np.zeros((tree.nodes, 1))
    by_node[tree.ends] = 0.1
    word = "abd" * 400
    got = tree.forward(tree.matrix([word]), by_node)[0, 0]
    assert -1200 * 17 < got < -400 * 16
    monkeypatch.setattr(L, "DENSE", 0)
    assert L.Tree(PIECES).forward(tree.matrix([word]), by_node)[0, 0] == got


def test_expected_counts_sum_to_the_letters():
    tree = L.Tree(PIECES)
    by_node = np.zeros((tree.nodes, 1))
    by_node[tree.ends] = 1 / len(PIECES)
    into = np.zeros_like(by_node)
    tree.expected(tree.matrix(["abab", "baba"]), by_node, np.array([[3.0], [0.0]]), into)
    sizes = np.array([len(p) for p in PIECES])
    assert abs((into[tree.ends][:, 0] * sizes).sum() - 3 * 5) < 1e-3


def test_expected_counts_by_hand():
    """One word's expected counts against all its segmentations."""
    tree = L.Tree(PIECES)
    by_node = np.zeros((tree.nodes, 1))
    by_node[tree.ends] = np.random.default_rng(2).dirichlet(np.ones(len(PIECES)))[:, None]
    known = dict(zip(PIECES, by_node[tree.ends][:, 0]))
    text = L.START + "abab"
    total, want = 0.0, Counter()
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts = "".join(c + "|" * cut for c, cut in zip(text, (*cuts, 0), strict=True)).split("|")
        # a letter may be a piece or a letter alone, which is no piece
        for alone in itertools.product(*[[False, True] if len(p) == 1 else [False] for p in parts]):
            chance = math.prod(L.LETTER if a else known.get(p, 0.0) for p, a in zip(parts, alone))
            total += chance
            for p, a in zip(parts, alone):
                if not a:
                    want[p] += chance
    into = np.zeros_like(by_node)
    tree.expected(tree.matrix(["abab"]), by_node, np.array([[2.0]]), into)
    for p, got in zip(PIECES, into[tree.ends][:, 0]):
        assert abs(got - 2 * want[p] / total) < 1e-9


def test_long_runs_are_taken_in_stretches_and_train():
    run = "ab" * 500
    assert "".join(L.words(run)) == run and {len(w) for w in L.words(run)} == {L.STRETCH}
    tree = L.Tree(PIECES)
    by_node = np.zeros((tree.nodes, 1))
    by_node[tree.ends] = 1 / len(PIECES)
    into = np.zeros_like(by_node)
    tree.expected(tree.matrix(["q" * L.STRETCH, "ab" * (L.STRETCH // 2)]), by_node, np.array([[1.0], [1.0]]), into)
    assert np.isfinite(into).all() and into.sum() > 10


def by_rounds(rows, pieces):
    """Training in one process, a word at a time."""
    languages = sorted({lang for lang, _ in rows})
    count = {g: Counter(w for lang, t in set(rows) if lang == g for w in L.words(t)) for g in languages}
    tree = L.Tree(pieces)
    chance = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(L.ROUNDS):
        by_node = np.zeros((tree.nodes, len(languages)))
        by_node[tree.ends] = chance
        into = np.zeros_like(by_node)
        for g, lang in enumerate(languages):
            for w, n in count[lang].items():
                one = np.zeros((1, len(languages)))
                one[0, g] = n
                tree.expected(tree.matrix([w]), by_node, one, into)
        got = into[tree.ends] + L.SMOOTHING
        chance = got / got.sum(axis=0)
    return chance


def test_training_and_prediction_against_one_process(spark):
    rows = [("xx", "abba baba cab"), ("yy", "bab bab acca"), ("xx", "a b c"), ("yy", "cabba bab"), ("yy", "cabba bab")]
    docs = spark.createDataFrame([(i if zlib.crc32(str(i).encode()) % 5 else i + 1000, g, t) for i, (g, t) in enumerate(rows)], "doc_id long, lang string, text string")
    docs = docs.filter(~L.held_out())
    kept = [(r["lang"], r["text"]) for r in docs.collect()]
    model = L.train(docs.repartition(3))
    assert np.allclose(model.chance, by_rounds(kept, model.vocabulary), rtol=1e-6)
    text = "babab cab a"
    tree = L.Tree(model.vocabulary)
    by_node = np.zeros((tree.nodes, 2))
    by_node[tree.ends] = model.chance
    sums = sum(tree.forward(tree.matrix([w]), by_node)[0] for w in L.words(text))
    want = np.exp(sums - sums.max()) / np.exp(sums - sums.max()).sum()
    got = L.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert got["lang_pred"] == model.languages[int(want.argmax())] and abs(got["score"] - want.max()) < 1e-9


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, f"l{i}", "some text") for i in range(30)], "doc_id long, lang string, text string")
    with pytest.raises(ValueError, match="more than 3"):
        L.train(docs)


def test_held_out_accuracy(spark):
    rows = L.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(docs)
    out = [r for r in rows if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in out) / len(out) > 0.97


def test_odd_rows_and_empty_tables(spark):
    rows = [(i, "the cat and the dog are here", "en", 1) for i in range(30)] + [(100 + i, "der hund und die katze sind hier", "de", 1) for i in range(30)]
    rows += [(200, None, "en", 1), (201, "", None, 1), (202, "12 34 ²", "en", 1), (None, "und die katze", None, 1), (203, "the " * 20000, None, 1), (203, "the " * 20000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(3)
    got = L.identify(docs, L.train(docs)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [by[k] for k in (0, 100, 200, 201, 202, None, 203)] == ["en", "de", "und", "und", "und", "de", "en"]
    empty = docs.limit(0)
    assert L.identify(empty, L.train(empty)).count() == 0
    assert {r["lang_pred"] for r in L.identify(docs, L.train(empty)).collect()} == {"und"}
