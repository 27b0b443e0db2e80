import hashlib
import random
import re

import numpy as np
import pytest

from tidewater.llm import decontaminate as D


def brute(texts, items, size=D.WINDOW):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
    out = []
    for doc, text in texts:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for k in range(max(1, len(v) - size + 1) if v else 0):
                g = v[k : k + size]
                for i in range(len(w) - len(g) + 1):
                    if w[i : i + len(g)] == g:
                        hit |= set(range(i, i + len(g)))
                        found |= {str(item)} - {"None"}
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("blocks", "listed"), [(D.BLOCK_PHRASES, D.LISTED_TERMS), (3, 2)])
def test_against_brute_force(spark, monkeypatch, blocks, listed):
    monkeypatch.setattr(D, "BLOCK_PHRASES", blocks)
    monkeypatch.setattr(D, "LISTED_TERMS", listed)
    rng = random.Random(5)
    vocabulary = ["a", "b", "É", "c1", "Dd", "e"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [(i, say(rng.randrange(60)) + rng.choice(["", "\n", "!?"])) for i in range(40)] + [(50, None), (51, ""), (3, "a B c1"), (3, "a B c1")]
    items = [(1, say(12)), (10, "a b-C1"), (2, None), (3, ""), (4, "é"), (1, "e e e"), (None, "b b b b")]
    texts += [(60, f"x {items[0][1]} y {items[0][1]}")]
    docs = spark.createDataFrame([(*r, "clash") for r in texts], "doc_id long, text string, segment string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(D.contamination(docs, bench)) == brute(texts, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(docs, bench).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rows(D.contamination(one, bench)) == brute([(1, "a b")], [])


def test_segments_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(D, "SEGMENT_WORDS", 20)
    docs = spark.createDataFrame([(i, f"x{i} alpha " + "pad " * (i % 7) + "beta") for i in range(30)], "doc_id long, text string").coalesce(1)
    index = D.build(docs)
    assert index.rows.count() > 5
    asked = D.phrases(spark.createDataFrame([("q", [b"alpha", b"beta"])], "item string, words array<binary>"))
    near = D.search(index, asked, distance=4).collect()
    assert {r["doc_id"] for r in near if r["items"]} == {i for i in range(30) if i % 7 <= 3}
    exact = D.search(index, asked).collect()
    assert {r["doc_id"] for r in exact if r["items"]} == {i for i in range(30) if i % 7 == 0}
    assert all(np.array_equal(r["begins"], [1]) for r in exact if r["items"])


def test_proximity_stays_in_a_document(spark):
    docs = spark.createDataFrame([(0, "x alpha"), (1, "beta y"), (2, "alpha " + "pad " * 300 + "beta")], "doc_id long, text string").coalesce(1)
    asked = D.phrases(spark.createDataFrame([("q", [b"alpha", b"beta"])], "item string, words array<binary>"))
    index = D.build(docs)
    found = lambda distance: {r["doc_id"] for r in D.search(index, asked, distance).collect() if r["items"]}
    assert found(1000) == {2} and found(300) == set()


def test_postings_stay_where_they_are(spark):
    """The index is joined by its buckets: only phrases are shuffled."""
    index = D.build(spark.createDataFrame([(0, "a b c")], "doc_id long, text string"))
    asked = D.phrases(spark.createDataFrame([("q", [b"a", b"b"])], "item string, words array<binary>"))
    (r,) = index.rows.select("task", "segment").collect()
    lists = spark.createDataFrame([(*r, [tuple(p) for p in asked.collect()])], "task int, segment long, phrases array<struct<item:string,terms:array<long>>>")
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with D.task_alone(spark):
            found = D.searched(index, lists, None)
            assert found.first()["begins"] == [0]
            plan = found._jdf.queryExecution().executedPlan().toString()
        assert spark.conf.get(key) == before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.index("positions") :]
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert "Exchange hashpartitioning(task" in plan and "Exchange" not in side[: side.index("FileScan")]


def test_a_file_for_each_task_and_no_table_left(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(D, "SEGMENT_WORDS", 20)
    before = {t.name for t in spark.catalog.listTables()}
    docs = spark.createDataFrame([(i, f"x{i} a b c d e f g") for i in range(300)], "doc_id long, text string").repartition(3)
    index = D.build(docs, f"{tmp_path}/index")
    assert index.rows.select("segment").distinct().count() > 60
    assert len(list((tmp_path / "index").glob("part-*"))) == 3
    asked = D.phrases(spark.createDataFrame([("q", [b"x7", b"a"])], "item string, words array<binary>"))
    assert [r["doc_id"] for r in D.search(index, asked).collect() if r["items"]] == [7]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_more_tasks_than_shuffle_partitions(spark):
    docs = spark.createDataFrame([(i, f"x{i} a b") for i in range(40)], "doc_id long, text string").repartition(9)
    index = D.build(docs)
    assert index.buckets == 9
    asked = D.phrases(spark.createDataFrame([("q", [b"x7", b"a"]), ("r", [b"a", b"b"])], "item string, words array<binary>"))
    got = {r["doc_id"]: r["items"] for r in D.search(index, asked).collect()}
    assert got == {i: ["q", "r"] if i == 7 else ["r"] for i in range(40)}


def test_a_text_longer_than_a_segment(spark):
    text = "w0 " + " ".join(f"w{i}" for i in range(D.SEGMENT_WORDS)) + " a b c"
    docs = spark.createDataFrame([(1, text), (2, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([("long", f"w{D.SEGMENT_WORDS - 1} a b c"), ("short", "a b")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in D.contamination(docs, bench).collect()}
    assert got == {1: (D.SEGMENT_WORDS + 4, 4, 2), 2: (2, 2, 1)}
