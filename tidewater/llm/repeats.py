"""Removal of repeated byte strings by a depth-limited, most-significant-digit radix sort.

Every window of 400 bytes belongs to its minimizer: the leftmost least hash of the 64-byte
strings in it. Equal windows have their minimizers at the same place, so only suffixes at
minimizers are sorted, about one in 170 bytes, and a minimizer stands for the run of windows
that belong to it. Passes go from the coarsest digit to the finest:

* A run whose minimizer's own 64 bytes occur nowhere else holds no repeat and drops out.
* A run whose whole stretch, from its first window's start to its last one's end, occurs
  elsewhere with the same minimizer holds repeats only, and is done.
* Any other run is cut into parts of 64, then 8, then 1 windows, each judged in the same way
  by the bytes that all its windows share and by the bytes that they cover together. One run
  of those that are done goes on beside runs that share its digit, as their partner.

At depth 400 a group of equal strings is exactly a repeated window. Groups are counted, never
gathered: a passage that a third of all documents share is a group of a partial aggregate.
Bytes that are claimed as equal are compared by 128-bit hashes; the 64-bit ones only drop
runs, which a collision can delay but not spoil.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, table, written

WINDOW = 400
#: Bytes of a minimizer's string.
GRAM = 64
#: Windows of a run at each pass after the first.
STEPS = (64, 8, 1)

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes, by doubling their length; GRAM is a power of two."""
    h, factor, n = data.astype(np.uint64) + np.uint64(1), _FACTOR, 1
    with np.errstate(over="ignore"):
        while n < GRAM:
            h = h[:-n] * factor + h[n:]
            factor, n = factor * factor, 2 * n
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def runs(hashes: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(minimizer, first window, last window) of each run of windows with one minimizer."""
    grams = window - GRAM + 1
    last = len(hashes) - grams
    out, s = [], 0
    while s <= last:
        p = s + int(hashes[s : s + grams].argmin())
        # the run ends where its minimizer is left behind, or a smaller hash comes in
        ahead = hashes[s + grams : p + grams + 1] < hashes[p]
        k = int(ahead.argmax()) if len(ahead) else 0
        to = s + k if len(ahead) and ahead[k] else p
        to = min(to, last)
        out.append((p, s, to))
        s = to + 1
    return out


KEYS = "doc_id long, row long, first int, low int, high int, lo int, short long, long1 long, long2 long"


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, row and data: rows with the same doc_id and text share a number."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64("doc_id", text).alias("row"), F.encode(text, "utf-8").alias("data"))


def _columns(rows: list[tuple], longs: list[bytes]) -> dict:
    pairs = np.frombuffer(b"".join(longs), "<i8").reshape(-1, 2)
    names = ("doc_id", "row", "first", "low", "high", "lo", "short")
    return dict(zip(names, zip(*rows, strict=True) if rows else ([],) * 7, strict=True)) | {"long1": pairs[:, 0], "long2": pairs[:, 1]}


def first_pass(rows: DataFrame, window: int) -> DataFrame:
    """Runs with their first keys. A run has windows that start `high` down to `low` bytes
    before its minimizer; its first window starts at `first`."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            out, longs = [], []
            for doc, row, data in zip(batch["doc_id"].to_pylist(), batch["row"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if len(data) < window:
                    continue
                hashes = gram_hashes(np.frombuffer(data, np.uint8))
                for p, a, b in runs(hashes, window):
                    out.append((doc, row, a, p - b, p - a, 0, int(hashes[p].view(np.int64))))
                    longs.append(xxhash.xxh3_128_digest(data[a : b + window]))
            return _columns(out, longs)

        return fn

    return arrow_map(rows, make, KEYS)


def stretches(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """wanted(doc_id, row, first, low, high) with the bytes that their windows cover."""
    need = wanted.groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r")).agg(F.collect_list(F.struct("first", "low", "high")).alias("runs"))
    some = rows.join(need, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d"))).dropDuplicates(["doc_id", "row"])
    cut = some.select("doc_id", "row", "data", F.explode("runs").alias("x"))
    size = F.col("x.high") - F.col("x.low") + window
    return cut.select("doc_id", "row", "x.first", "x.low", "x.high", F.substring("data", F.col("x.first") + 1, size).alias("stretch"))


def next_pass(parents: DataFrame, step: int, window: int) -> DataFrame:
    """The parts of `step` windows of undecided runs (lo, size, and the run's stretch)."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            out, longs = [], []
            for r in batch.to_pylist():
                stretch, low, high = r["stretch"], r["low"], r["high"]
                for lo in range(r["lo"], r["lo"] + r["size"], step):
                    a, b = max(lo, low), min(lo + step - 1, high)
                    if a > b:
                        continue
                    shared = stretch[max(0, high - lo) : high - (lo + step - 1) + window]
                    out.append((r["doc_id"], r["row"], r["first"], low, high, lo, xxhash.xxh3_64_intdigest(shared) - (1 << 63)))
                    longs.append(xxhash.xxh3_128_digest(stretch[high - b : high - a + window]))
            return _columns(out, longs)

        return fn

    return arrow_map(parents, make, KEYS)


def decided(keys: DataFrame, step: int | None, window: int) -> tuple[DataFrame, DataFrame]:
    """From written keys: stretches of repeats (doc_id, row, begin, end), and the runs that the
    next pass cuts. Of runs with one stretch a single one goes on, if others share its digit:
    it is done itself, but others may share some of its windows."""
    # written, so that the join's own shuffle meets a hot digit and can be split
    often = written(keys.groupBy("lo", "short").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    some = written(keys.join(often, ["lo", "short"]))
    stretch = ["lo", "short", "long1", "long2"]
    one = F.min(F.struct("doc_id", "row", "first", "low", "high")).alias("one")
    groups = written(some.groupBy(*stretch).agg(F.count("*").alias("n"), one))
    a = F.greatest("lo", "low") if step else F.col("low")
    b = F.least(F.col("lo") + (step - 1), F.col("high")) if step else F.col("high")
    place = F.col("first") + F.col("high")  # the minimizer
    done = some.join(groups.filter("n > 1").drop("one"), stretch)
    done = done.select("doc_id", "row", (place - b).alias("begin"), (place - a + window).alias("end"))
    mixed = written(groups.groupBy("lo", "short").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    return done, groups.join(mixed, ["lo", "short"]).select("one.*", "lo")


def repeated(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, begin, end): stretches whose every window of bytes occurs elsewhere."""
    done, left = decided(written(first_pass(rows, window)), None, window)
    held = written(stretches(rows, left.drop("lo"), window))
    size = STEPS[0] * -(-(window - GRAM + 1) // STEPS[0])
    parents = held.select("*", F.lit(0).alias("lo"), F.lit(size).alias("size"))
    for step in STEPS:
        more, left = decided(written(next_pass(parents, step, window)), step, window)
        done = done.unionByName(more)
        key = left.distinct().select(F.col("doc_id").alias("d"), F.col("row").alias("r"), F.col("first").alias("f"), "lo", F.lit(step).alias("size"))
        same = (F.col("row") == F.col("r")) & (F.col("first") == F.col("f")) & F.col("doc_id").eqNullSafe(F.col("d"))
        parents = held.join(key, same).drop("d", "r", "f")
    return done


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of `window` bytes that covers it also starts anywhere else, in
    this document or another; all strings are judged on the input. Null texts are empty.
    Documents shorter than the window keep all. Repeated rows repeat each other's strings.
    """
    rows = _numbered(docs)
    found = repeated(rows, window).groupBy(F.col("doc_id").alias("d"), F.col("row").alias("r"))
    found = found.agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    joined = rows.join(found, (F.col("row") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    joined = joined.select("doc_id", "data", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends"))

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            out = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
            for doc, data, begins, ends in zip(*(batch[c].to_pylist() for c in ("doc_id", "data", "begins", "ends")), strict=True):
                spans: list[list[int]] = []
                for a, b in zip(begins or (), ends or (), strict=True):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                for k, x in zip(out, (doc, len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()), strict=True):
                    out[k].append(x)
            return out

        return fn

    return arrow_map(joined, make, REMOVED)


def op10_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


OP10_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, octet_length(b) AS n, hex(b) AS x FROM d),
w AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, x, unnest(range(n - 399)) AS i FROM h WHERE n >= 400)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
s AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
t AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, run, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS before FROM t),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY run) AS kept FROM e JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, cast(coalesce(n_removed, 0) AS bigint) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""
