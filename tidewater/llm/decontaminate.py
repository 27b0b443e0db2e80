"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments. A segment holds the postings of about 130,000 words of
whole documents: the sorted 64-bit hashes of its terms and, term after term, the ascending
positions of each. Documents follow one another in a segment with a gap between them, so
that no phrase spans two. Every word of every document is indexed.

A search takes phrases as a table. Each phrase is sent to the segments that hold its rarest
term, which takes a look at the segments' lists of terms alone; a phrase with a term that no
segment has falls out. In a segment the lists of positions, each less its term's offset in the
phrase, are intersected from the rarest term on. Proximity searches take the same lists and
look for each term within a distance of the rarest one, in the same document. The index is
bucketed by the task that wrote it, a file for each, and phrases are dealt by the same number,
so that phrases move and postings don't.

Terms are compared by xxh64: among 10^7 terms two share a hash with a chance of about 3e-6.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, map_batches, record_batch, shared_dir, table, written

#: Words of a segment, about: it ends with the document that reaches them.
SEGMENT_WORDS = 1 << 17
#: Empty places between two documents of a segment.
GAP = 1
#: Bytes of a row group of the index, which a writing and a reading task hold.
GROUP_BYTES = 8 << 20
#: Words of a contamination window.
WINDOW = 10
#: Terms up to which tasks get a list of those that matter (8 bytes each); with more of them
#: all terms of a segment are sent, and a join picks.
LISTED_TERMS = 1 << 20
#: Phrases of a segment that are searched together, about.
BLOCK_PHRASES = 20_000

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: A segment: the task that wrote it, its documents' ids, first places and numbers of words,
#: then terms and postings.
INDEX = "task int, segment long, docs binary, starts binary, lengths binary, terms binary, edges binary, positions binary"


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; UTF-8 bytes above 127 belong to words."""
    return WORD.findall(text.encode().lower()) if text else []


def hashes(terms: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, terms), np.uint64)


@dataclass(frozen=True)
class Index:
    """An index table, and the number of its buckets by task."""

    rows: DataFrame
    buckets: int


#: Buckets that Spark lets a table have.
MOST_BUCKETS = 100_000


def build(docs: DataFrame, path: str | None = None) -> Index:
    """The index of all words of all documents, a table in the shared folder. Each task that
    reads documents writes one file, as all its segments share a bucket; buckets are as many as
    these tasks, or as the session has shuffle partitions if that is more.

    Null and empty texts have no words and stand in the index with length 0. A document of
    any length lies in one segment. The documents should be a table: what they come from is
    planned once more to count its tasks.
    """
    spark = docs.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0

        def fresh():
            number: defaultdict[bytes, int] = defaultdict()
            number.default_factory = number.__len__
            return number, [], [], [], [], 0

        number, ids, starts, lengths, held, at = fresh()

        def flush() -> pa.RecordBatch:
            terms = hashes(number)
            order = np.argsort(terms)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            term = rank[np.concatenate(held)] if held else np.zeros(0, np.int32)
            place = np.concatenate([np.arange(a, a + n, dtype=np.uint32) for a, n in zip(starts, lengths, strict=True)])
            edges = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(order)))]).astype("<u4")
            context = TaskContext.get()
            task = context.partitionId() if context else 0
            missing = [d is None for d in ids]
            numbers = np.array([-(1 << 63) if m else d for d, m in zip(ids, missing, strict=True)], "<i8")
            return record_batch({
                "task": [task], "segment": [(task << 32) + made], "docs": [numbers.tobytes()], "starts": [np.array(starts, "<u4").tobytes()], "lengths": [np.array(lengths, "<u4").tobytes()],
                "terms": [terms[order].astype("<u8").tobytes()], "edges": [edges.tobytes()], "positions": [place[np.argsort(term, kind="stable")].astype("<u4").tobytes()],
            }, INDEX)

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = words(text)
                ids.append(doc)
                starts.append(at)
                lengths.append(len(found))
                if found:
                    held.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                at += len(found) + GAP
                if at >= SEGMENT_WORDS:
                    yield flush()
                    number, ids, starts, lengths, held, at = fresh()
                    made += 1
        if ids:
            yield flush()

    texts = docs.select("doc_id", "text")
    rows = map_batches(texts, run, INDEX)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    name, buckets = f"tidewater_{uuid.uuid4().hex}", min(tasks, MOST_BUCKETS)
    # a row is a megabyte and more: the writer looks at its buffer after each, not after 100
    groups = {"parquet.block.size": GROUP_BYTES, "parquet.page.size.row.check.min": 1, "path": path or shared_dir(spark)}
    rows.write.bucketBy(buckets, "task").options(**groups).saveAsTable(name)
    index = spark.table(name)
    # the files are the folder's, and the plan has the buckets by now: the catalog needs no entry
    index.schema  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    return Index(index, buckets)


class Segment:
    """A segment's lists of positions by term."""

    def __init__(self, row: dict):
        self.docs = np.frombuffer(row["docs"], "<i8")
        self.starts = np.frombuffer(row["starts"], "<u4").astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.terms = np.frombuffer(row["terms"], "<u8")
        self.edges = np.frombuffer(row["edges"], "<u4").astype(np.int64)
        self.positions = np.frombuffer(row["positions"], "<u4")

    def find(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in this segment's list, or -1."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == terms, at, -1)

    def list(self, term: int) -> np.ndarray:
        return self.positions[self.edges[term] : self.edges[term + 1]].astype(np.int64)

    def phrase(self, terms: list[int]) -> np.ndarray:
        """First places of the phrase of these terms."""
        sizes = self.edges[np.array(terms) + 1] - self.edges[terms]
        found = None
        for k in np.argsort(sizes, kind="stable").tolist():
            own = self.list(terms[k]) - k
            if found is None:
                found = own
            else:
                at = np.searchsorted(own, found)
                at[at == len(own)] = 0
                found = found[own[at] == found]
            if not len(found):
                break
        return found

    def near(self, terms: list[int], distance: int) -> np.ndarray:
        """Places of the rarest term that have each other term within the distance, in the same
        document."""
        terms = sorted(set(terms), key=lambda t: int(self.edges[t + 1] - self.edges[t]))
        found = self.list(terms[0])
        doc = np.searchsorted(self.starts, found, "right") - 1
        low = np.maximum(found - distance, self.starts[doc])
        high = np.minimum(found + distance, self.starts[doc] + self.lengths[doc] - 1)
        for t in terms[1:]:
            own = self.list(t)
            first = np.searchsorted(own, low)
            kept = (first < len(own)) & (own[np.minimum(first, len(own) - 1)] <= high)
            found, low, high = found[kept], low[kept], high[kept]
        return found


def phrases(rows: DataFrame) -> DataFrame:
    """(item, terms) of rows (item string, words array<binary>)."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            return {"item": batch["item"], "terms": [hashes(w).view(np.int64) for w in batch["words"].to_pylist()]}

        return fn

    return arrow_map(rows, make, PHRASES)


PHRASES = "item string, terms array<long>"


def listed(terms: DataFrame) -> np.ndarray | None:
    """The terms, ascending, if they are few enough to be sent to every task."""
    if terms.count() > LISTED_TERMS:
        return None
    return np.unique(terms.toArrow().column(0).to_numpy().view(np.uint64))


def vocabulary(index: Index, terms: DataFrame, by_segment: bool) -> DataFrame:
    """(task, segment, term, n) of how often the segments have the terms, or, without by_segment,
    sums of a task's segments, whose task and segment are null."""
    schema = "task int, segment long, term long, n long"
    held = index.rows.sparkSession.sparkContext.broadcast(listed(terms))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = held.value
        total = np.zeros(0 if some is None else len(some), np.int64)

        def emit(segment: int | None, terms: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            task = None if segment is None else segment >> 32
            return record_batch({"task": [task] * len(n), "segment": [segment] * len(n), "term": terms.view(np.int64), "n": n}, schema)

        for batch in batches:
            for row in batch.to_pylist():
                own, n = np.frombuffer(row["terms"], "<u8"), np.diff(np.frombuffer(row["edges"], "<u4").astype(np.int64))
                if some is None:
                    yield emit(row["segment"], own, n)
                    continue
                at = np.searchsorted(own, some)
                there = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == some) if len(own) else np.zeros(0, np.int64)
                if by_segment:
                    yield emit(row["segment"], some[there], n[at[there]])
                else:
                    total[there] += n[at[there]]
        if total.any():
            yield emit(None, some[total > 0], total[total > 0])

    return map_batches(index.rows.select("segment", "terms", "edges"), run, schema).join(terms, "term", "left_semi")


def rarest(index: Index, asked: DataFrame) -> DataFrame:
    """(item, terms, term) of the phrases whose terms all occur, with the rarest of them."""
    each = asked.select("item", "terms", F.explode(F.array_distinct("terms")).alias("term"))
    often = vocabulary(index, written(each.select("term").distinct()), False).groupBy("term").agg(F.sum("n").alias("n"))
    found = each.join(written(often), "term").groupBy("item", "terms").agg(F.min(F.struct("n", "term")).alias("least"), F.count("*").alias("found"))
    return found.filter(F.col("found") == F.size(F.array_distinct("terms"))).select("item", "terms", "least.term")


HITS = "segment long, ordinal int, doc_id long, n_words long, begins array<long>, ends array<long>, items array<string>"


def search(index: Index, asked: DataFrame, distance: int | None = None) -> DataFrame:
    """For each document and block of phrases (item, terms), the document's hit words as
    disjoint ranges from begins up to ends, and the items of the phrases that occur.

    distance: None for exact phrases, else each term within so many places of the rarest.
    Every document has a row, with empty lists if nothing is found.
    """
    asked = written(asked.filter(F.size("terms") > 0).distinct())
    least = written(rarest(index, asked))
    places = written(vocabulary(index, written(least.select("term").distinct()), True).select("task", "segment", "term"))
    sent = written(least.join(places, "term").select("task", "segment", "item", "terms"))
    n = written(sent.groupBy("segment").agg(F.count("*").alias("n")))
    block = F.pmod(F.xxhash64("item", "terms"), F.ceil(F.col("n") / BLOCK_PHRASES))
    lists = sent.join(n, "segment").groupBy("task", "segment", block.alias("block")).agg(F.collect_list(F.struct("item", "terms")).alias("phrases"))
    with task_alone(index.rows.sparkSession):
        return written(searched(index, lists.select("task", "segment", "phrases"), distance))


@contextlib.contextmanager
def task_alone(spark: SparkSession) -> Iterator[None]:
    """Lets a join on task and segment take rows as they lie by task, for what is run inside."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def searched(index: Index, lists: DataFrame, distance: int | None) -> DataFrame:
    """The hits of lists (task, segment, phrases), which are dealt as the index is."""
    both = index.rows.join(lists.repartition(index.buckets, "task"), ["task", "segment"], "left")

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            columns = {k: [] for k in ("segment", "ordinal", "doc_id", "n_words", "begins", "ends", "items")}
            for row in batch.to_pylist():
                _search(Segment(row), row["segment"], row["phrases"] or [], distance, columns)
            return columns

        return fn

    return arrow_map(both, make, HITS)


def _search(segment: Segment, number: int, asked: list[dict], distance: int | None, columns: dict) -> None:
    n = len(segment.docs)
    begun: list[np.ndarray] = []
    ended: list[np.ndarray] = []
    items: dict[int, set[str]] = defaultdict(set)
    at = segment.find(np.array([t for p in asked for t in p["terms"]], np.int64).view(np.uint64)).tolist()
    end = 0
    for p in asked:
        first, end = end, end + len(p["terms"])
        terms = at[first:end]
        if min(terms) < 0:
            continue
        if distance is None:
            places, size = segment.phrase(terms), len(terms)
        else:
            places, size = segment.near(terms, distance), 1
        if len(places):
            begun.append(places)
            ended.append(places + size)
            if p["item"] is not None:
                for d in np.unique(np.searchsorted(segment.starts, places, "right") - 1).tolist():
                    items[d].add(p["item"])
    ranges: dict[int, tuple[list[int], list[int]]] = {}
    if begun:
        edges = np.zeros(int(segment.starts[-1] + segment.lengths[-1]) + 2, np.int32)
        np.add.at(edges, np.concatenate(begun), 1)
        np.add.at(edges, np.concatenate(ended), -1)
        inside = np.cumsum(edges) > 0
        turns = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True):
            d = int(np.searchsorted(segment.starts, a, "right")) - 1
            own = ranges.setdefault(d, ([], []))
            own[0].append(a - int(segment.starts[d]))
            own[1].append(b - int(segment.starts[d]))
    columns["segment"] += [number] * n
    columns["ordinal"] += range(n)
    columns["doc_id"] += [None if d == -(1 << 63) else d for d in segment.docs.tolist()]
    columns["n_words"] += segment.lengths.tolist()
    columns["begins"] += [ranges[d][0] if d in ranges else [] for d in range(n)]
    columns["ends"] += [ranges[d][1] if d in ranges else [] for d in range(n)]
    columns["items"] += [sorted(items[d]) if d in items else [] for d in range(n)]


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, terms): windows of the items' words. An item of fewer words, but not none, is
    one window; null and empty items have none."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            items, terms = [], []
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = hashes(words(text)).view(np.int64)
                for i in range(max(1, len(found) - size + 1) if len(found) else 0):
                    items.append(item)
                    terms.append(found[i : i + size])
            return {"item": items, "terms": terms}

        return fn

    return arrow_map(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"), make, PHRASES)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside any occurrence of a window of an item. Null and empty
    documents have no words and no hits. Repeated rows each have a row; items that share an
    item_id count once, items without item_id make hits but are not counted. Without any
    window nothing is contaminated.
    """
    hits = search(build(docs), windows(benchmark, size))
    merged = hits.groupBy("segment", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("begins")).alias("begins"), F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            out = {"doc_id": batch["doc_id"], "n_words": batch["n_words"], "n_hit": [], "n_items": [], "items_sha256": [], "contaminated": []}
            for begins, ends, items in zip(*(batch[c].to_pylist() for c in ("begins", "ends", "items")), strict=True):
                hit = to = 0
                for a, b in sorted(zip(begins, ends, strict=True)):
                    hit += max(0, b - max(a, to))
                    to = max(to, b)
                out["n_hit"].append(hit)
                out["n_items"].append(len(items))
                out["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
                out["contaminated"].append(hit > 0)
            return out

        return fn

    return arrow_map(merged.drop("segment", "ordinal"), make, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark
), g AS (
  SELECT item_id, least(len(w), 10) AS n, unnest([w[i:i + least(len(w), 10) - 1] FOR i IN range(1, greatest(len(w) - 9, 1) + 1)]) AS g
  FROM b WHERE len(w) > 0
), p AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n
), h AS (
  SELECT doc_id, i, n, item_id FROM (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM p) JOIN (SELECT DISTINCT item_id, n, g FROM g) USING (n, g)
), c AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id
), k AS (
  SELECT doc_id, count(x) AS n_items, string_agg(x, ',' ORDER BY x) AS items
  FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS x FROM h) GROUP BY doc_id
)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
