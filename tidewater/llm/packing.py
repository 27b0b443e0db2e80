"""Best-fit packing, planned over a histogram of lengths.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths,
at most `capacity` numbers, reaches the driver. Best-fit decreasing runs over its counts:
one step places as many pieces of a length as there are sequences with the same room left.
The plan says for each length which ranks go to which run of sequences, at which offset.
Pieces then take their slots by a join on their rank within their length. A rank is the
place within a small bucket plus the sizes of the buckets before it, so that a length that
most pieces share is never ranked in one task.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, table, written
from tidewater.llm.wordcodec import codec

CAPACITY = 2048
#: Pieces in a bucket of ranks, about; and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: its ids and then end_id, cut where they exceed the
    capacity; the first piece takes the remainder, all others are full. A null text is
    empty, and has the end id alone. Repeated rows each have their own pieces."""

    def make():
        words = codec(vocabulary, False)
        end = np.array([end_id], "<u4").tobytes()

        def fn(batch: pa.RecordBatch) -> dict:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for doc, ids in zip(batch["doc_id"].to_pylist(), words.encode(batch["text"].to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                at = k = 0
                while at < n:
                    to = at + (n % capacity or capacity) if k == 0 else at + capacity
                    for name, x in zip(out, (doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])), strict=True):
                        out[name].append(x)
                    at, k = to, k + 1
            return out

        return fn

    return arrow_map(docs.select("doc_id", "text"), make, PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, rank_from, rank_to, sequence_from, offset): pieces of that length with
    ranks from rank_from up to rank_to go to the sequences from sequence_from on, one
    each, at that offset. A step uses up either a length or a run of sequences, so there
    are few rows however many pieces there are.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    rooms: list[int] = []  # rooms left in open sequences, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, how many)
    made = 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted((x for x in histogram if histogram[x] > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[k]
                m = min(n, left)
                rows.append((length, rank, rank + m, first, capacity - room))
                leave(room - length, first, m)
                leave(room, first + m, n - m)
                rank, left = rank + m, left - m
            else:
                each = capacity // length
                n = left // each or 1
                for j in range(min(each, left)):
                    rows.append((length, rank, rank + n, made, j * length))
                    rank, left = rank + n, left - n
                    used = (j + 1) * length
                leave(capacity - used, made, n)
                made += n
    return rows


def place(got: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with a salt, by which they are
    dealt to buckets, so that a document in a third of all rows lies in all of them. Equal
    pieces of a repeated document are interchangeable and take different slots."""
    spark = got.sparkSession
    counts = {r["length"]: r["n"] for r in got.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(LEAST_BUCKETS, sum(counts.values()) // BUCKET_ROWS)
    rows = plan(counts, capacity)
    schema = "length long, rank_from long, rank_to long, sequence_from long, offset long"
    slots = spark.createDataFrame(rows, schema)
    got = got.withColumn("bucket", F.pmod("salt", F.lit(buckets)))
    sizes = got.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn(
        "before",
        F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)),
    ).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = got.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    at = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    slots = slots.withColumnRenamed("length", "slot_length")
    # the plan is bounded by the number of lengths, whatever the number of pieces
    found = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & at)
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset",
    )


def pack(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Packs whole documents into sequences of at most `capacity` tokens.

    Null and empty texts have the end id alone. An empty table gives no rows. Repeated
    rows, and rows that share a doc_id, are packed each by itself. Columns beside doc_id
    and text aren't read.
    """
    vocabulary = vocabulary or vocabulary_path("byte_bpe_50k.json")
    salt = (F.rand(7) * (1 << 31)).cast("int")
    return place(written(pieces(docs, vocabulary, end_id, capacity).withColumn("salt", salt)), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
