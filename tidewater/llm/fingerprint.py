"""Document fingerprints from closed syncmers, and their likeness by positions.

A stretch of SPAN code points is an anchor where the least hash of its inner substrings of
INNER code points is that of its first or its last one. That depends on the stretch alone, so
a passage has the same anchors wherever it stands, and any SPAN - INNER + 1 stretches in a row
hold one. A fingerprint is the text's anchors in order: the gap from the one before, at most
SPAN - INNER, in a byte, and 32 bits of hash, as base64. Texts shorter than SPAN are one anchor.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, map_batches, record_batch, ship, table

SPAN, INNER = 24, 6

#: Code points that are worked on at a time; a longer text is worked on alone.
CHUNK = 1 << 18

_M, _A, _B = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_ENTRY = np.dtype([("gap", "u1"), ("hash", "<u4")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _rolled(codes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each stretch of width numbers."""
    n = len(codes) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= _M
        out += codes[i : i + n]
    return _mixed(out)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each width numbers in a row, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def _fingerprints(codes: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Fingerprints of texts that stand in codes one after the other."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    places, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if len(codes) >= SPAN:
        inner = _rolled(codes, INNER)
        reach = SPAN - INNER
        least = _least(inner, reach + 1)
        places = np.flatnonzero((least == inner[: len(least)]) | (least == inner[reach:]))
        whole = np.searchsorted(ends, places, "right")
        places = places[places + SPAN <= ends[whole]]
        mixed = np.zeros(len(places), np.uint64)
        for i in range(0, SPAN, INNER):
            mixed = _mixed(mixed * _M + inner[places + i])
        hashes = (mixed >> np.uint64(32)).astype(np.uint32)
    cuts = np.searchsorted(places, np.concatenate([starts, ends[-1:]]))
    out = []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if 0 < b - a < SPAN:
            one = int.from_bytes(hashlib.sha256(codes[a:b].astype("<u4").tobytes()).digest()[:4], "little")
            entries = np.array([(0, one)], _ENTRY)
        else:
            at = places[cuts[i] : cuts[i + 1]]
            entries = np.empty(len(at), _ENTRY)
            entries["gap"] = np.diff(at, prepend=a)
            entries["hash"] = hashes[cuts[i] : cuts[i + 1]]
        out.append(base64.b64encode(entries.tobytes()))
    return out


def fingerprint_all(texts: list[str]) -> list[str]:
    out, held, size = [], [], 0

    def flush() -> None:
        if held:
            codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            out.extend(x.decode() for x in _fingerprints(codes, np.cumsum([len(t) for t in held])))

    for text in texts:
        if size + len(text) > CHUNK:
            flush()
            held, size = [], 0
        held.append(text)
        size += len(text)
    flush()
    return out


def anchors(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of a fingerprint's anchors."""
    entries = np.frombuffer(base64.b64decode(fingerprint), _ENTRY)
    return np.cumsum(entries["gap"], dtype=np.int64), entries["hash"]


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Each hash with how often it has stood before."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.arange(len(hashes))
    seen = np.empty(len(hashes), np.int64)
    seen[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return hashes.astype(np.int64) << 31 | seen


def likeness(a: str, b: str) -> float:
    """Twice the anchors that stand in the same order in both, by all anchors of both: the
    longest chain of common anchors that ascends in either. 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = anchors(a)[1], anchors(b)[1]
    if not len(x) or not len(y):
        return 0.0
    _, i, j = np.intersect1d(_numbered(x), _numbered(y), assume_unique=True, return_indices=True)
    chain: list[int] = []
    for place in j[np.argsort(i)].tolist():
        at = bisect_left(chain, place)
        chain[at : at + 1] = [place]
    return 2 * len(chain) / (len(x) + len(y))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each document; a null text counts as empty, whose
    fingerprint is empty. Rows that repeat come out as often; other columns aren't read."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            texts = batch["text"].to_pylist()
            return {"doc_id": batch["doc_id"], "n_chars": [len(t) for t in texts], "fingerprint": fingerprint_all(texts)}

        return fn

    return arrow_map(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), make, "doc_id long, n_chars long, fingerprint string")


#: Characters of a range of documents, on an average, and the most ranges.
RANGE_CHARS, RANGES = 1 << 26, 100_000

ROWS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _ranges(rows: DataFrame) -> tuple[list, int]:
    """The first (known, doc_id, tie) of each range of documents, in order; ranges are as many
    as the texts need. Numbers alone are sorted for it, and a row for each range is collected."""
    spark = rows.sparkSession
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS)))
    sorted_ = rows.select("known", "doc_id", "tie").repartitionByRange(n, "known", "doc_id", "tie")
    firsts = sorted_.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("known", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie")).alias("first"))
    return sorted(tuple(r["first"]) for r in firsts.collect()), n


def ranged(docs: DataFrame) -> DataFrame:
    """Documents dealt to ranges of doc_id, null first; rows of one doc_id by a hash of their
    texts. The first document of a range stands once more at the end of the range before it,
    that of the first range at the end of the last one, marked as extra. So each row's next
    one is in its own range."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("known", F.col("doc_id").isNotNull()).withColumn("tie", F.xxhash64("text"))
    firsts, n = _ranges(rows)

    def places(known: pa.Array, doc_id: pa.Array, tie: pa.Array) -> pa.Array:
        from bisect import bisect_right

        out = []
        for key in zip(known.to_pylist(), doc_id.to_pylist(), tie.to_pylist(), strict=True):
            at = max(0, bisect_right(firsts, key) - 1)
            own = {"range": at, "extra": False}
            out.append([own, {"range": (at or len(firsts)) - 1, "extra": True}] if key == firsts[at] else [own])
        return pa.array(out, pa.list_(pa.struct([("range", pa.int32()), ("extra", pa.bool_())])))

    ship(docs.sparkSession)
    dealt = F.arrow_udf(places, "array<struct<range:int,extra:boolean>>")
    rows = rows.withColumn("at", dealt("known", F.coalesce("doc_id", F.lit(0)), "tie"))
    rows = rows.select("known", "doc_id", "tie", "text", F.inline("at"))
    return rows.repartition(n, "range").sortWithinPartitions("range", "extra", "known", "doc_id", "tie")


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last half is the next
    document's beginning, and its likeness to that and to the next document.

    Next is by ascending doc_id, null first, after the last the first; rows of one doc_id
    stand in the order of a hash of their texts, so that rows that repeat follow each other. A
    null text counts as empty. A range of documents is read row by row, with one batch held.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            rows = list(zip(*(batch[c].to_pylist() for c in ("range", "extra", "doc_id", "text")), strict=True))
            prints = fingerprint_all([r[3] for r in rows])
            pairs = []
            for row, print_ in zip(rows, prints, strict=True):
                if last and last[0][0] == row[0] and not last[0][1]:
                    pairs.append((*last, row[3], print_))
                last = row, print_
            edited = [text[: len(text) - len(text) // 2] + after[: len(text) // 2] for (_, _, _, text), _, after, _ in pairs]
            out = {k: [] for k in ROWS.replace(",", "").split()[::2]}
            for ((_, _, doc_id, text), own, _, after), new, changed in zip(pairs, edited, fingerprint_all(edited), strict=True):
                digest = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                for k, x in zip(out, (doc_id, len(text), digest, own, changed, likeness(own, changed), likeness(own, after)), strict=True):
                    out[k].append(x)
            if pairs:
                yield record_batch(out, ROWS)

    return map_batches(ranged(docs).select("range", "extra", "doc_id", "text"), run, ROWS)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text counts as empty and has an empty fingerprint; an empty table gives no rows."""
    return compared(table(spark, sf_dir, "documents", "doc_id", "text"))
