import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import packing as P
from tidewater.llm.wordcodec import WordCodec

VOCABULARIES = [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)]


@pytest.fixture(scope="module", params=VOCABULARIES, ids=lambda x: x[0])
def pair(request):
    from tokenizers import Tokenizer

    name, folds = request.param
    return WordCodec(P.vocabulary_path(name), folds), Tokenizer.from_file(P.vocabulary_path(name))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcéÉİΣσ  \n\n\t\x1c.,!'’#12½²́ñdonts_<|endoftext|>漢"), max_size=40), max_size=6))
def test_codec_equals_whole_encoding(pair, texts):
    words, tokenizer = pair
    got = words.encode(texts)
    want = [tokenizer.encode(t, add_special_tokens=False).ids if t else [] for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 50), max_size=30))
def test_plan_places_each_rank_once_without_overlap(histogram):
    used, ranks = {}, {}
    for length, a, b, first, offset in P.plan(histogram, 64):
        ranks.setdefault(length, []).extend(range(a, b))
        for i in range(b - a):
            used.setdefault(first + i, []).append((offset, length))
    assert {k: v for k, v in histogram.items() if v} == {k: len(v) for k, v in ranks.items()}
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())
    for items in used.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(k * v for k, v in histogram.items())
    assert len(used) <= 2 * total / 64 + 1  # at most one sequence is half empty


def test_pack_against_plain_encoding(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "a b c", "word " * 5000, "a b c", "x\n\ny", "é" * 3000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(2, "a b c", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = P.pack(docs, capacity=256).toPandas()
    tokenizer = Tokenizer.from_file(P.vocabulary_path("byte_bpe_50k.json"))
    want = []
    for i, t, _ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out[cols].values.tolist())) == sorted(want)
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
        assert s["length"].sum() <= 256
    assert out["sequence_id"].nunique() == -(-out["length"].sum() // 256)


def test_a_repeated_document_takes_slots_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(P, "LEAST_BUCKETS", 8)
    docs = spark.range(900).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'one and the same', concat('w', id)) as text").repartition(3)
    out = P.pack(docs, capacity=32).toPandas()
    assert len(out) == 900 and not out.duplicated(["sequence_id", "offset"]).any()
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 32


def test_pack_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
