"""Approximate nearest neighbours by cross-polytope hashing.

A table of the index rotates unit vectors twice, each time by three rounds of random signs and
a fast Hadamard transform, and takes the nearest signed axis of either: (2d)^2 buckets. A query
probes, in each table, the buckets whose two axes lie near enough to it, looks them up among
the rows' sorted buckets, and every row that any table gives is a candidate, scored by the
inner product of the original vectors in double precision.

How near is near enough is measured: a bounded sample of the queries is compared with all rows,
and the threshold is the one by which RECALL of these queries' true neighbours are met. Rows
lie in bands of similar length, within a factor of two. Lengths that differ in a band are evened
out by one more coordinate, as a maximum inner product then is a smallest angle, and a query
probes every band. Bands of few rows, in which the best are at angles so wide that hashing
can't tell them apart, are scored whole.

Rows and queries are tables, both cut into cells of bounded size. Each cell of rows meets each
cell of queries of its width in one task: a bucket that holds a third of all rows lies spread
over all cells, and nothing of the tables but the sample passes the driver. Queries that
meet few candidates, as those that point away from nearly all rows, meet every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, map_batches, record_batch, table, written

TABLES, NEAREST = 64, 20
#: Axes of a rotation that a query's probes are made of, the nearest ones.
PROBE_AXES = 16
#: Queries of each width that thresholds are measured on, and the share of their neighbours to be met.
SAMPLE_QUERIES, RECALL = 256, 0.93
#: Rows up to which a band is scored whole.
WHOLE = 1000
#: Candidates, in multiples of the results wanted, under which a query meets all rows.
FEW = 5
#: Numbers in the vectors of a cell of rows and of a cell of queries, at most.
ROW_NUMBERS, QUERY_NUMBERS = 1 << 22, 1 << 18
#: Rows below which a cell isn't cut for more tasks.
LEAST_CELL = 8192
#: Possible buckets of a table up to which a list of all of them is held.
LISTED = 1 << 20
#: Pairs of queries and rows that are marked at a time.
BLOCK_PAIRS = 1 << 23
SEED = 20240611

#: met, on one row of each query and cell, is how many candidates the cell had for it.
FOUND = "query_id long, vec_id long, score double, met long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


class Rotations:
    """The pseudo-rotations of all tables, two for each, drawn from a fixed seed."""

    #: Widths up to which rotations go as one product of matrices, which is then faster.
    NARROW = 256

    def __init__(self, width: int, tables: int | None = None, seed: int = SEED):
        self.width, self.tables = max(2, 1 << (width - 1).bit_length()), tables or TABLES
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (2 * self.tables, 3, self.width))
        self.matrix = np.stack([self.turned(np.eye(self.width, dtype=np.float32), s) for s in self.signs], axis=1) if self.width <= self.NARROW else None

    def turned(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x = hadamard(x * s) / np.float32(self.width**0.5)
        return x

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Each rotation of each row: rows, rotations, coordinates."""
        x = np.pad(x.astype(np.float32), ((0, 0), (0, self.width - x.shape[1])))
        if self.matrix is not None:
            return (x @ self.matrix.reshape(self.width, -1)).reshape(len(x), 2 * self.tables, self.width)
        return np.stack([self.turned(x, s) for s in self.signs], axis=1)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Each row's bucket in each table: first axis times 2d and second axis. Axis i with
        sign - is d + i."""
        y = self(x)
        axis = np.abs(y).argmax(axis=2)
        axis = axis + self.width * (np.take_along_axis(y, axis[:, :, None], 2)[:, :, 0] < 0)
        return (axis[:, ::2] * (2 * self.width) + axis[:, 1::2]).astype(np.uint32)

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest PROBE_AXES signed axes of each rotation of each row, and how near."""
        y = self(x)
        both = np.concatenate([y, -y], axis=2)
        n = min(PROBE_AXES, both.shape[2])
        axes = np.argpartition(-both, n - 1, axis=2)[:, :, :n]
        return axes, np.take_along_axis(both, axes, 2)

    def probes(self, x: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each table, its number, rows, and the buckets of theirs at least so near."""
        axes, near = self.near(x)
        for t in range(self.tables):
            row, i, j = np.nonzero(near[:, 2 * t, :, None] + near[:, 2 * t + 1, None, :] >= least)
            yield t, row, axes[row, 2 * t, i] * (2 * self.width) + axes[row, 2 * t + 1, j]

    def nearness(self, x: np.ndarray, query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """For each pair of a query (its place in x) and a row's buckets, how near the nearest
        bucket is that the query can probe; -inf if there is none."""
        axes, near = self.near(x)
        best = np.full(len(query), -np.inf)
        for t in range(self.tables):
            total = np.zeros(len(query))
            for part, axis in ((2 * t, codes[:, t] // (2 * self.width)), (2 * t + 1, codes[:, t] % (2 * self.width))):
                total += np.where(axes[query, part] == axis[:, None], near[query, part], -np.inf).max(axis=1)
            best = np.maximum(best, total)
        return best


def usable(vectors: DataFrame) -> DataFrame:
    """Vectors that take part: neither null nor zero, all components finite."""
    if vectors.schema["embedding"].dataType.simpleString() != "array<float>":
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", "embedding").filter("vec_id is not null").filter(e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1).astype(np.float64)


def _evened(x: np.ndarray, longest: float) -> np.ndarray:
    """Rows over the longest length, with a last coordinate that makes them unit vectors."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def _products(rows: np.ndarray, query: np.ndarray, product: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Inner products of rows with a query. Where those of components may be beyond all doubles,
    both are scaled by powers of two, so that only a sum that is itself beyond is infinite."""
    by = [int(np.frexp(np.abs(x).max(initial=0.0))[1]) for x in (rows, query)]
    if sum(by) < 1000:
        return product(rows, query)
    with np.errstate(over="ignore"):
        return np.ldexp(product(np.ldexp(rows, -by[0]), np.ldexp(query, -by[1])), sum(by))


def _by(values: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The places of each value, with the value."""
    for value in np.unique(values):
        yield np.flatnonzero(values == value), int(value)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """The k best of each query: by score, then the smaller vec_id; more goes along."""
    order = np.lexsort((ids, -scores, query))
    query = query[order]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    keep = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
    return query[keep], *(x[order][keep] for x in (ids, scores, *more))


@dataclass(frozen=True)
class Band:
    """Rows of one width and of similar lengths: their number, their longest length, which is
    None where lengths are even, and how near a probed bucket is at least."""

    width: int
    band: int
    n: int
    longest: float | None
    least: float = -np.inf

    def unit(self, queries: np.ndarray) -> np.ndarray:
        x = queries / np.abs(queries).max(axis=1, keepdims=True)  # squares of the longest and shortest doubles are none
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return x if self.longest is None else np.pad(x, ((0, 0), (0, 1)))

    def rotations(self) -> Rotations:
        return Rotations(self.width + (self.longest is not None))


class Index:
    """An index table with its bands."""

    def __init__(self, rows: DataFrame, bands: list[Band]):
        self.rows, self.bands = rows, bands


def build(vectors: DataFrame) -> Index | None:
    """Indexes every usable vector; None if there are none. Vectors of each number of
    components have bands of their own."""
    # lengths by way of the greatest component, as squares of doubles can be infinite or zero
    top = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    square = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + (x / F.col("top")) * (x / F.col("top")))
    length = F.least(F.sqrt("square") * F.col("top"), F.lit(np.finfo(np.float64).max.item()))
    # a band's edges are odd powers of the root of two, so that unit vectors lie in its middle
    band = F.floor(F.log2("square") / 2 + F.log2("top") + 0.5).cast("int")
    rows = usable(vectors).withColumn("top", top).withColumn("square", square).withColumn("band", band).withColumn("length", length)
    groups = rows.groupBy(F.size("embedding").alias("width"), "band")
    got = groups.agg(F.count("*").alias("n"), F.max("length").alias("long"), F.min("length").alias("short")).collect()
    if not got:
        return None
    bands = [Band(r["width"], r["band"], r["n"], r["long"] if r["short"] < r["long"] * 0.9995 else None) for r in got]
    by = {(b.width, b.band): b for b in bands}
    schema = f"vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, width int, band int, codes binary"

    def make():
        rotations: dict[tuple[int, int], Rotations] = {}

        def fn(batch: pa.RecordBatch) -> dict:
            codes = np.empty((batch.num_rows, TABLES), np.uint32)
            numbers, widths = batch["band"].to_numpy(), batch["embedding"].value_lengths().to_numpy()
            for of, width in _by(widths):
                x = _matrix(batch["embedding"].take(pa.array(of)))
                for at, number in _by(numbers[of]):
                    band = by[width, number]
                    unit = band.unit(x[at]) if band.longest is None else _evened(x[at], band.longest)
                    if (width, number) not in rotations:
                        rotations[width, number] = band.rotations()
                    codes[of[at]] = rotations[width, number].buckets(unit)
            return {"vec_id": batch["vec_id"], "embedding": batch["embedding"], "width": widths, "band": batch["band"], "codes": [c.tobytes() for c in codes]}

        return fn

    return Index(written(arrow_map(rows.select("vec_id", "embedding", "band"), make, schema)), bands)


def nearest(rows: DataFrame, sample: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(width, query, band, codes) of the true k nearest rows of each query of a sample, which
    has ids and vectors by width."""
    held = rows.sparkSession.sparkContext.broadcast(sample)  # SAMPLE_QUERIES vectors of each width
    schema = "width int, query int, vec_id long, score double, band int, codes binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for at, width in _by(batch["width"].to_numpy()):
                if width not in held.value:
                    continue
                part = batch.take(pa.array(at))
                ids, asked = held.value[width]
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = np.nan_to_num(asked @ _matrix(part["embedding"]).T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                scores[ids[:, None] == part["vec_id"].to_numpy()[None, :]] = -np.inf
                n = min(k, scores.shape[1])
                top = np.argpartition(-scores, n - 1, axis=1)[:, :n].ravel()
                query = np.repeat(np.arange(len(ids)), n)
                new = (query, part["vec_id"].to_numpy()[top], scores[query, top], part["band"].to_numpy()[top], np.array(part["codes"].to_pylist(), object)[top])
                keep = new[2] > -np.inf
                new = tuple(x[keep] for x in new)
                old = best.get(width)
                best[width] = _best(*(new[:3] if old is None else map(np.concatenate, zip(old[:3], new[:3], strict=True))), k, *(new[3:] if old is None else map(np.concatenate, zip(old[3:], new[3:], strict=True))))
        for width, (query, ids, scores, band, codes) in best.items():
            yield record_batch({"width": [width] * len(query), "query": query, "vec_id": ids, "score": scores, "band": band, "codes": list(codes)}, schema)

    order = Window.partitionBy("width", "query").orderBy(F.desc("score"), "vec_id")
    return map_batches(rows, run, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def measured(index: Index, queries: DataFrame, k: int) -> list[Band]:
    """The bands with thresholds by which RECALL of a sample's neighbours are met. A band that
    holds none of them takes the widest threshold of the others; those of few rows have none."""
    large = [b for b in index.bands if b.n > WHOLE]
    if not large:
        return index.bands
    order = Window.partitionBy("width").orderBy(F.xxhash64("vec_id"), "vec_id")
    some = queries.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE_QUERIES).filter(F.col("width").isin(sorted({b.width for b in large})))
    sample: dict[int, tuple[list, list]] = {}
    for r in some.select("width", "vec_id", "embedding").collect():
        sample.setdefault(r["width"], ([], []))[0].append(r["vec_id"])
        sample[r["width"]][1].append(r["embedding"])
    asked = {w: (np.array(ids, np.int64), np.array(x, np.float64)) for w, (ids, x) in sample.items()}
    pairs: dict[tuple[int, int], list] = {}
    for r in nearest(index.rows, asked, k).select("width", "query", "band", "codes").collect() if asked else ():
        pairs.setdefault((r["width"], r["band"]), []).append((r["query"], np.frombuffer(r["codes"], np.uint32)))
    least: dict[tuple[int, int], float] = {}
    for b in large:
        if got := pairs.get((b.width, b.band)):
            at = b.rotations().nearness(b.unit(asked[b.width][1]), np.array([q for q, _ in got]), np.stack([c for _, c in got]).astype(np.int64))
            least[b.width, b.band] = float(np.quantile(at, 1 - RECALL, method="lower")) - 1e-5
    widest = min(least.values(), default=-np.inf)
    return [Band(b.width, b.band, b.n, b.longest, least.get((b.width, b.band), widest) if b.n > WHOLE else -np.inf) for b in index.bands]


class Cell:
    """Rows of a band, and what queries find among them."""

    def __init__(self, band: Band, ids: np.ndarray, rows: np.ndarray, codes: np.ndarray):
        self.band, self.ids, self.rows, self.codes = band, ids, rows, codes
        self.order = np.argsort(codes, axis=0, kind="stable") if np.isfinite(band.least) else None
        self.rotations = band.rotations() if self.order is not None else None

    def slots(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a table: the buckets that hold rows, ascending, where each begins in the order of
        rows, with the end, and the place of each possible bucket among them, or -1 (empty where
        they are too many to list)."""
        held = self.codes[self.order[:, t], t]
        first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
        every = (2 * self.rotations.width) ** 2
        place = np.full(every if every <= LISTED else 0, -1, np.int32)
        if len(place):
            place[held[first]] = np.arange(len(first))
        return held[first], np.append(first, len(held)), place

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        """A mark for each query and row: whether any of the probed buckets holds it."""
        if self.order is None:
            return np.ones((len(queries), len(self.ids)), bool)
        hit = np.zeros((len(queries), len(self.ids)), bool)
        for t, query, bucket in self.rotations.probes(self.band.unit(queries), self.band.least):
            buckets, edges, place = self.slots(t)
            if len(place):
                slot = place[bucket]
            else:
                slot = np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)
                slot[buckets[slot] != bucket] = -1
            full = np.flatnonzero(slot >= 0)
            first, n = edges[slot[full]], edges[slot[full] + 1] - edges[slot[full]]
            ends = np.cumsum(n)
            at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(first, n)
            hit[np.repeat(query[full], n), self.order[at, t]] = True
        return hit

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """query_id, vec_id, score and met of the best k candidates of each query."""
        step = max(1, BLOCK_PAIRS // max(1, len(self.ids)))
        for a in range(0, len(ids), step):
            hit = self.candidates(queries[a : a + step])
            hit &= ids[a : a + step, None] != self.ids[None, :]
            for q, marks in enumerate(hit, a):
                at = np.flatnonzero(marks)
                if not len(at):
                    continue
                met = len(at)
                if met > 2 * k:
                    rough = _products(self.rows[at], queries[q], lambda x, y: x @ y)
                    last = np.partition(rough, met - k)[met - k]
                    at = at[(rough >= last - 1e-9 * np.abs(rough).max()) | ~np.isfinite(rough)]
                # summed row by row in one order, so that equal rows have equal scores wherever they lie
                scores = _products(self.rows[at], queries[q], lambda x, y: (x * y).sum(axis=1))
                _, found, scores = _best(np.zeros(len(at), np.int64), self.ids[at], scores, k)
                yield np.full(len(found), ids[q]), found, scores, np.where(np.arange(len(found)) == 0, met, 0)


def meet(index: Index, bands: list[Band], queries: DataFrame, asking: dict[int, int], k: int) -> DataFrame:
    """FOUND rows of each cell of queries (vec_id, embedding, width) with each cell of rows.
    asking is the number of queries by width."""
    spark = index.rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells, first = [], 0
    for b in bands:
        if b.width not in asking:
            continue
        row_cells = max(-(-b.n * b.width // ROW_NUMBERS), min(tasks, -(-b.n // LEAST_CELL)))
        query_cells = max(1, -(-asking[b.width] * b.width // QUERY_NUMBERS))
        cells.append((b.width, b.band, row_cells, query_cells, first))
        first += row_cells * query_cells
    if not cells:
        return spark.createDataFrame([], FOUND)
    by = {(b.width, b.band): b for b in bands}
    grid = F.broadcast(spark.createDataFrame(cells, "width int, band int, row_cells long, query_cells long, first long"))  # a row for each band

    def dealt(df: DataFrame, side: int, own: str, other: str) -> DataFrame:
        """Each row in a cell of its own side, once for each cell of the other."""
        own_cell, cell = F.floor(F.rand(SEED) * F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        cut = df.withColumn("own", own_cell).withColumn("other", cell)
        row_cell, query_cell = ("own", "other") if side else ("other", "own")
        group = F.col("first") + F.col(row_cell) * F.col("query_cells") + F.col(query_cell)
        return cut.select(group.cast("int").alias("group"), F.lit(side).alias("side"), "width", "band", "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "codes")

    rows = dealt(index.rows.join(grid, ["width", "band"]), 1, "row_cells", "query_cells")
    asked = dealt(queries.withColumn("codes", F.lit(None).cast("binary")).join(grid, "width"), 0, "query_cells", "row_cells")
    both = asked.unionByName(rows).repartitionById(first, "group").sortWithinPartitions("group", "side")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            side = whole["side"].to_numpy()
            if not side.any() or side.all():
                return
            n = int((side == 0).sum())
            band = by[whole["width"][0].as_py(), whole["band"][0].as_py()]
            ids, x = whole["vec_id"].to_numpy(), _matrix(whole["embedding"])
            codes = np.frombuffer(b"".join(whole["codes"].slice(n).to_pylist()), np.uint32).reshape(len(ids) - n, -1)
            found = list(Cell(band, ids[n:], x[n:], codes).search(ids[:n], x[:n], k))
            if found:
                yield record_batch(dict(zip(("query_id", "vec_id", "score", "met"), map(np.concatenate, zip(*found, strict=True)), strict=True)), FOUND)

        last = None
        for batch in batches:
            groups = batch["group"].to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if held and groups[a] != last:
                        yield from emit()
                    last = groups[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from emit()

    return map_batches(both, run, FOUND)


def search(index: Index, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query, nearest first,
    ties to the smaller vec_id. A query is compared with the rows of its own width.

    A query's own row, and any other with its vec_id, is no candidate of it. Of queries that
    share a vec_id one asks. Repeated rows of the index are each found. A query with fewer
    than FEW * k candidates asks again, of all rows. Very wide vectors lie in smaller cells.
    """
    one = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asking = written(one.withColumn("width", F.size("embedding")))
    counts = lambda df: {r["width"]: r["n"] for r in df.groupBy("width").agg(F.count("*").alias("n")).collect()}
    bands = measured(index, asking, k)
    found = meet(index, bands, asking, counts(asking), k)
    if any(np.isfinite(b.least) for b in bands):
        found = written(found)
        met = found.groupBy("query_id").agg(F.sum("met").alias("met"))
        few = asking.join(met, F.col("vec_id") == F.col("query_id"), "left").filter(F.coalesce("met", F.lit(0)) < FEW * k)
        few = written(few.select("vec_id", "embedding", "width"))
        if n := counts(few):
            again = meet(index, index.bands, few, n, k)
            found = found.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors null, zero or with null or non-finite components take no part; a table
    without usable vectors gives no rows."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    index = build(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, vectors.filter("vec_id % 20 = 0"))
