import base64
import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from tidewater.llm import warc as W


def brute(pages):
    best = {}
    for page_id, _, html in pages:
        best[html or ""] = max(best.get(html or "", -1), page_id)
    out = []
    for page_id, _, html in pages:
        raw, b = (html or "").encode(), best[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "response" if b == page_id else "revisit", None if b == page_id else b))
    return sorted(out, key=str)


PAGES = [(i, f"http://h{i % 3}/é/{i}", "<p>" + "äx" * (i % 5) * (i % 7)) for i in range(60)]
PAGES += [(100, None, None), (101, "u\r\nX: y", ""), (102, "u", "\x1f\x8b\x08WARC/1.0\r\n\r\n"), (103, "u", "long " * 60000), (5, PAGES[5][1], PAGES[5][2])]
COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("split", [W.SPLIT_BYTES, 97])
def test_round_trip_at_any_cuts(spark, split):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, size string").repartition(3)
    got = W.read(W.write(pages), split).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == brute(PAGES)
    html = {p[0]: (p[2] or "").encode() for p in PAGES}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in got if r["record_type"] == "response")


def test_splits_own_each_record_once_despite_false_magic():
    rng = random.Random(3)
    raw = [W.record(i, f"u{i}", b"\0" * 20, 4, None, bytes(rng.randbytes(50)) + b"\x1f\x8b\x08" * 3) for i in range(40)]
    stored = [gzip.compress(x, compresslevel=0) for x in raw]  # the magic in the payload shows
    data = b"".join(stored)
    for step in (1, 7, 100, 5000, len(data)):
        got = [x for a in range(0, len(data), step) for x in W.records(W.Range(io.BytesIO(data), len(data), 64), a, min(len(data), a + step))]
        assert got == raw


def test_a_task_for_each_split(spark):
    rng = random.Random(8)
    rows = [(i, f"u{i}", rng.randbytes(300).hex()) for i in range(400)]
    files = W.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))
    split = 4096
    splits = sum(-(-r["size"] // split) for r in files.collect())
    got = W.read(files, split)
    assert got.count() == 400 and splits > 20
    used = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert got.rdd.getNumPartitions() == splits and used >= 0.9 * splits


def test_least_bytes(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long one"), (4, "d", "long one")], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in W.read(W.write(pages, least_bytes=5)).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_empty_table(spark):
    assert W.read(W.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
