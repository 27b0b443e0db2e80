import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import tokenfiles as K
from tidewater.llm.packing import vocabulary_path


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=3000), st.data())
def test_block_gives_any_id_and_any_slice(ids, data):
    levels = K.encode(np.array(ids, np.uint32))
    block = K.Block(len(ids), len(levels), *(b"".join(x[i].tobytes() for x in levels) for i in range(3)))
    i = data.draw(st.integers(0, len(ids) - 1))
    assert block[i] == ids[i]
    a = data.draw(st.integers(0, len(ids) - 1))
    b = data.draw(st.integers(a, len(ids)))
    assert block.slice(a, b).tolist() == ids[a:b]


def test_files_round_trip(spark):
    from tokenizers import Tokenizer

    texts = {9: "Some words, here.", 2: None, 5: "", 7: "Déjà vu \n 12", -3: "x " * 400, None: "no id"}
    rows = [(i, t, "clash") for i, t in texts.items()] + [(9, "Another text", "clash"), (9, "Some words, here.", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    out = K.read(K.write(docs, vocabulary_path("word_bpe_49k.json"))).orderBy("start").collect()
    tokenizer = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    at = 0
    assert [r["doc_id"] for r in out] == [None, -3, 2, 5, 7, 9, 9, 9]
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    crc = lambda t: zlib.crc32(np.array(ids(t), "<u4").tobytes())
    assert sorted((r["doc_id"] or 0, r["ids_crc32"]) for r in out) == sorted((i or 0, crc(t)) for i, t, _ in rows)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(K, "RANGE_DOCS", 10)
    docs = spark.range(95).selectExpr("id * 7 % 95 as doc_id", "concat('w', id, ' end') as text")
    out = K.read(K.write(docs, vocabulary_path("word_bpe_49k.json"))).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in out] == list(range(95))
    assert [r["start"] for r in out[1:]] == np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()


def test_a_hot_doc_id_lies_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(K, "RANGE_DOCS", 20)
    monkeypatch.setattr(K, "BLOCK_IDS", 40)
    docs = spark.range(600).selectExpr("case id % 3 when 0 then 7 when 1 then null else id end as doc_id", "if(id % 2 = 0, 'same', concat('w', id)) as text").repartition(4)
    files = K.write(docs, vocabulary_path("word_bpe_49k.json"))
    sizes = [r["n"] for r in files.groupBy("part").agg({"n_ids": "count"}).withColumnRenamed("count(n_ids)", "n").collect()]
    assert len(sizes) >= 25 and files.groupBy("part").agg({"block": "max"}).agg({"max(block)": "max"}).first()[0] < 20
    out = K.read(files).orderBy("start").collect()
    known = [-(1 << 63) if r["doc_id"] is None else r["doc_id"] for r in out]
    assert known == sorted(known) and len(known) == 600
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()]


def test_long_text(spark):
    text = "word and another " * 120_000
    out = K.read(K.write(spark.createDataFrame([(2, "a"), (1, text)], "doc_id long, text string"), vocabulary_path("word_bpe_49k.json"))).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [1, 2] and out[0]["n_tokens"] > K.BLOCK_IDS / 4


def test_empty_table(spark):
    assert K.read(K.write(spark.createDataFrame([], "doc_id long, text string"), vocabulary_path("word_bpe_49k.json"))).count() == 0
