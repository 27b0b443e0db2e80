import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import test_decontaminate, test_neardups, test_secrets
from tidewater.llm.common import written
from tidewater.llm.packing import vocabulary_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(100_000, None, "en", None, 0), (100_001, "12 %% 34", None, "x", 8), (None, "le la de les des un une", None, None, 3)], docs.schema).unionByName(docs.filter("doc_id = 3"))
    frames = [docs.unionByName(extra)]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], SF)))
    return [f.collect() for f in frames]


def test_columns_stay(stages):
    for before, after in zip(stages[:4], stages[1:5]):
        assert [list(r.asDict()) for r in after[:1]] == [list(r.asDict()) for r in before[:1]]


def test_language_stage_drops_only_what_has_no_language(stages):
    gone = {r["doc_id"] for r in stages[0]} - {r["doc_id"] for r in stages[1]}
    assert gone == {100_000, 100_001}
    assert {r["lang"] for r in stages[1] if r["doc_id"] is None} == {"fr"}


def test_one_document_of_each_group_stays(stages):
    want = {r[0] for r in test_neardups.brute([(r["doc_id"], r["text"]) for r in stages[1]]) if r[3]}
    assert {r["doc_id"] for r in stages[2]} == want
    assert len(stages[2]) == len({r["doc_id"] for r in stages[2]})


def test_contaminated_documents_go(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {r[0] for r in test_decontaminate.brute([(r["doc_id"], r["text"]) for r in stages[2]], items) if not r[5]}
    assert {r["doc_id"] for r in stages[3]} == want and len(want) < len(stages[2])


def test_secrets_are_replaced_and_the_rest_kept(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    assert len(stages[4]) == len(stages[3])
    for r in stages[4]:
        old = before[r["doc_id"]]
        assert not test_secrets.brute(r["text"])
        pieces = [re.escape(x) for x in r["text"].split("[SECRET]")]
        assert re.fullmatch(".+?".join(pieces), old["text"], re.S)
        if not test_secrets.brute(old["text"]):
            assert r["text"] == old["text"] and r["n_chars"] == old["n_chars"]


def test_packing_covers_every_token(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0] for r in stages[4]}
    seen = {k: 0 for k in ids}
    for r in stages[5]:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r["doc_id"]] += len(part)
    assert seen == {k: len(v) for k, v in ids.items()}


def test_columns_of_any_name_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    extra = ["base", "spans", "bad", "lang_pred", "lang_score", "_row", "kept"]
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF))
    row = docs.first()
    assert [row[c] for c in extra] == list(range(len(extra)))
    assert corpus_pipeline.packed(spark, docs, SF).count() >= docs.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_rows_that_share_a_doc_id_or_have_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [" ".join(f"{w}{i}" for i in range(30)) for w in "abcd"]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[2]), (4, texts[1]), (None, texts[0]), (None, texts[3])]
    given = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, given, SF).collect()), key=str)
    assert got == sorted([(1, texts[0]), (1, texts[1]), (3, texts[2]), (None, texts[0]), (None, texts[3])], key=str)

    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = max(items, key=lambda t: len(t.split()))
    rows = [(None, bad), (None, texts[0]), (5, bad), (5, texts[1]), (6, texts[2])]
    given = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminated(spark, given, SF).collect()), key=str)
    assert got == sorted([(None, texts[0]), (5, texts[1]), (6, texts[2])], key=str)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        assert docs.count() == 0


def test_near_duplicates_before_decontamination_see_every_text(spark):
    """Very long, empty and null texts go through the stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"{w}{i}" for i in range(20_000) for w in ("the", "and", "house"))
    rows = [(1, long), (2, long + " end"), (3, ""), (4, None), (5, "the house and the garden are here")]
    given = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, given, SF).collect()}
    assert kept == {1, 3, 4, 5}
    assert {r["doc_id"] for r in corpus_pipeline.decontaminated(spark, given, SF).collect()} == {1, 2, 3, 4, 5}
    assert corpus_pipeline.without_secrets(spark, given, SF).count() == 5
