"""Token ids in files of directly addressable codes.

A block holds the ids of consecutive documents. Each id is split into chunks of eight bits,
lowest first. Level 1 holds the first chunk of every id; a bitmap of that level says which
ids go on to level 2, which holds the second chunk of just those, and so on. A rank
directory has the number of set bits before every 512th bit, so that the place of an id in
the next level is one lookup and a count over at most 512 bits: any id is read without
decoding others. Blocks lie as rows of a Parquet table (see FILES), ordered by the ids'
places in the corpus; Spark's writers and readers move them, on any store that it knows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, map_batches, record_batch, table, written
from tidewater.llm.packing import vocabulary_path
from tidewater.llm.wordcodec import codec

CHUNK_BITS, DIRECTORY_BITS = 8, 512
#: Documents in a range of ids, about; a range is written by one task, as one or more blocks.
RANGE_DOCS = 4_000
#: Ids after which a block ends, at the end of a document.
BLOCK_IDS = 1 << 18

#: A block: its range and place in it, the documents' ids and first places within the block,
#: the number of ids, and for each level the chunks, the bitmap and the rank directory.
FILES = "part int, block int, docs binary, starts binary, n_ids long, levels int, chunks binary, bitmaps binary, directories binary"


def encode(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels (chunks as bytes, bitmap as bytes, rank directory) of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS
        goes = more > 0
        bits = np.packbits(goes, bitorder="little")
        ones = np.add.reduceat(goes.astype(np.uint32), np.arange(0, len(goes), DIRECTORY_BITS)) if len(goes) else np.zeros(0, np.uint32)
        levels.append(((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(ones)]).astype("<u4")))
        if not goes.any():
            return levels
        rest = more[goes]


class Block:
    """Random access to the ids of an encoded block."""

    def __init__(self, n: int, levels: int, chunks: bytes, bitmaps: bytes, directories: bytes):
        self.levels, c, b, d = [], 0, 0, 0
        for _ in range(levels):
            words = -(-n // DIRECTORY_BITS) + 1
            ranks = np.frombuffer(directories, "<u4", words, d)
            self.levels.append((np.frombuffer(chunks, np.uint8, n, c), np.frombuffer(bitmaps, np.uint8, -(-n // 8), b), ranks))
            c, b, d, n = c + n, b + -(-n // 8), d + 4 * words, int(ranks[-1])

    def rank(self, level: int, i: int) -> int:
        """Set bits before bit i."""
        _, bits, ranks = self.levels[level]
        word = i // DIRECTORY_BITS
        own = int.from_bytes(bits[word * DIRECTORY_BITS // 8 : -(-i // 8)].tobytes(), "little")
        return int(ranks[word]) + (own & ((1 << (i - word * DIRECTORY_BITS)) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        value = shift = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i, shift = self.rank(level, i), shift + CHUNK_BITS
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids from a up to b."""
        out = at = None
        for level, (chunks, bits, _) in enumerate(self.levels):
            part = chunks[a:b].astype(np.uint32)
            if out is None:
                out = part
            else:
                out[at] |= part << np.uint32(CHUNK_BITS * level)
            goes = np.flatnonzero(np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a])
            if not len(goes):
                break
            at = goes if at is None else at[goes]
            a = self.rank(level, a)
            b = a + len(goes)
        return out


def placed() -> tuple[Column, Column]:
    """What rows are ordered by: doc_id, a null one before all others, and a random number, as
    one doc_id, or none, may stand in a third of all rows."""
    return F.coalesce("doc_id", F.lit(-(1 << 63))).alias("known"), (F.rand(5) * (1 << 31)).cast("long").alias("salt")


def edges(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """doc_id and salt at which each range but the first begins: 16 bytes for RANGE_DOCS
    documents. Only doc_id is read."""
    parts = max(1, docs.count() // RANGE_DOCS)
    if parts == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = docs.select(*placed()).repartitionByRange(parts, "known", "salt")
    least = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("known", "salt")).alias("least"))
    got = sorted((r["least"]["known"], r["least"]["salt"]) for r in least.collect())
    got = got[:: max(1, len(got) // parts)][1:]  # a session may have dealt them to more
    return np.array([d for d, _ in got], np.int64), np.array([s for _, s in got], np.int64)


def part_of(doc: np.ndarray, salt: np.ndarray, at: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The range of each document: the number of edges not above it."""
    part, last = np.searchsorted(at, doc, "left"), np.searchsorted(at, doc, "right")
    for i in np.flatnonzero(part < last):
        part[i] += np.searchsorted(salts[part[i] : last[i]], salt[i], "right")
    return part


def encoded(docs: DataFrame, vocabulary: str, end_id: int, ranges: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(part, doc_id, salt, wide, ids): each text's range, and its ids and then end_id as
    little-endian 16-bit numbers where all of them fit, else 32-bit ones (wide)."""
    held = docs.sparkSession.sparkContext.broadcast(ranges)

    def make():
        words = codec(vocabulary, True)
        end = np.array([end_id], "<u4").tobytes()

        def fn(batch: pa.RecordBatch) -> dict:
            ids = [np.frombuffer(x + end, "<u4") for x in words.encode(batch["text"].to_pylist())]
            wide = [bool(x.max() > 0xFFFF) for x in ids]
            part = part_of(batch["known"].to_numpy(), batch["salt"].to_numpy(), *held.value)
            packed = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(ids, wide, strict=True)]
            return {"part": part, "doc_id": batch["doc_id"], "salt": batch["salt"], "wide": wide, "ids": packed}

        return fn

    return arrow_map(docs.select("doc_id", *placed(), "text"), make, "part int, doc_id long, salt long, wide boolean, ids binary")


def write(docs: DataFrame, vocabulary: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order and returns the files.

    Ranges are found from doc_id alone, which is cheap to read; texts are encoded once and
    only ids are dealt out. Rows that share a doc_id follow one another in any order, nulls in
    doc_id come first; either may lie in several ranges.
    """
    ranges = edges(docs)
    rows = encoded(docs, vocabulary, end_id, ranges)
    rows = rows.repartitionById(len(ranges[0]) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "salt")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs_, held, size, k = None, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            levels = encode(ids)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            missing = np.array([d is None for d in docs_])
            numbers = np.where(missing, -(1 << 63), [d or 0 for d in docs_]).astype("<i8")
            return record_batch({
                "part": [now], "block": [k], "docs": [numbers.tobytes()], "starts": [starts.astype("<u4").tobytes()], "n_ids": [len(ids)], "levels": [len(levels)],
                "chunks": [b"".join(x[0].tobytes() for x in levels)], "bitmaps": [b"".join(x[1].tobytes() for x in levels)], "directories": [b"".join(x[2].tobytes() for x in levels)],
            }, FILES)

        for batch in batches:
            for p, doc, wide, raw in zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "wide", "ids")), strict=True):
                if held and (p != now or size >= BLOCK_IDS):
                    yield flush()
                    docs_, held, size, k = [], [], 0, k + 1 if p == now else 0
                now = p
                docs_.append(doc)
                held.append(np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.uint32))
                size += len(held[-1])
        if held:
            yield flush()

    return written(map_batches(rows.select("part", "doc_id", "wide", "ids"), blocks, FILES), path)


def read(files: DataFrame) -> DataFrame:
    """Each document as it stands in the files: its first place in the corpus, its number of
    ids, and their CRC. Ids are read by their places, document by document."""
    before = lambda window: F.coalesce(F.sum("n_ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # places of the ranges, a row each in one task, and of the blocks in their range
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).withColumn("first", before(Window.orderBy("part"))).drop("n_ids")
    bases = files.select("part", "block", "n_ids").withColumn("own", before(Window.partitionBy("part").orderBy("block")))
    bases = bases.join(parts, "part").select("part", "block", (F.col("first") + F.col("own")).alias("base"))

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            out = {k: [] for k in ("part", "block", "doc_id", "own", "n_tokens", "ids_crc32")}
            for r in batch.to_pylist():
                block = Block(r["n_ids"], r["levels"], r["chunks"], r["bitmaps"], r["directories"])
                starts = np.frombuffer(r["starts"], "<u4").tolist()
                for doc, a, b in zip(np.frombuffer(r["docs"], "<i8").tolist(), starts[:-1], starts[1:], strict=True):
                    crc = zlib.crc32(block.slice(a, b).astype("<u4").tobytes())
                    for k, x in zip(out, (r["part"], r["block"], None if doc == -(1 << 63) else doc, a, b - a, crc), strict=True):
                        out[k].append(x)
            return out

        return fn

    rows = arrow_map(files, make, "part int, block int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return rows.join(bases, ["part", "block"]).select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have the end id alone; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return read(write(docs, vocabulary_path("word_bpe_49k.json"), end_id=2))
