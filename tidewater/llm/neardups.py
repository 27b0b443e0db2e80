"""Near duplicates by one-permutation MinHash, banded buckets and star-shaped candidates.

One pass hashes a document's distinct five-word shingles to 64 bits and keeps the least hash
of each of 256 bins. Empty bins take the value of the bin to which a hash of their own number
leads, tried again until that one is full (optimal densification). Bands of five bins make 51
bucket keys: two sets of similarity 0.75 share no bucket with a chance of about 1e-6.

Equal sets become one class first. In a bucket the class that meets most others over all
buckets is the centre, and only it is compared with the rest, on their full sets; then it
leaves the bucket and, where several components are left, another centre takes its place. So
a bucket of n classes that are alike gives n - 1 candidates and not n squared.

After STARS such rounds what still meets across components is parted by rare shingles, again
in linear work: two sets that may be linked share one of the rarest quarter of their shingles
(prefix filtering), so a bucket is cut by the components of classes that share such shingles.
Classes that meet in a bucket for a common passage alone fall apart there. What then still
meets is heavily edited copies. Their pairs are not made into rows but bounded where they lie,
in blocks: each set is also a bitmap of one bit of each hash, and the common bits of two
bitmaps, with an allowance for bits that stand for more than one hash, are never fewer than
the common shingles. Pairs whose bound can't reach the threshold are no links; the few others
are compared on their full sets. So every pair of a bucket is in one component, or compared,
or proved to be too different.

Classes are numbered when their table is written. Components are found by large-star and
small-star steps over tables; the driver sees counts alone. A hot bucket is a group of a
partial aggregate and a skewed key of a join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, map_batches, record_batch, table, written

WORDS = 5
#: Similarity of a link, in hundredths.
SIMILARITY = 75
BINS, BAND_BINS = 256, 5
BANDS = BINS // BAND_BINS
#: Tries of densification before an empty bin takes the next full one.
TRIES = 4096
#: Rounds of stars, and bits of a set's bitmap and classes of a block of what they leave.
STARS, BITS, BLOCK_CLASSES = 2, 8192, 1024
#: Edges of a centre that one group of comparisons takes.
STAR_EDGES = 512
#: Words whose shingles are hashed at a time.
BLOCK_WORDS = 1 << 18

_RNG = np.random.default_rng(977)
_FACTORS = _RNG.integers(1, 1 << 63, WORDS, np.uint64) | np.uint64(1)
_LENGTHS = _RNG.integers(1, 1 << 63, WORDS, np.uint64)
_BAND_SEEDS = _RNG.integers(1, 1 << 63, BANDS, np.uint64)
_LEADS = _RNG.integers(0, BINS, (TRIES, BINS))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles. Fewer words than five are one
    shingle; a text without words has none."""
    out: list[np.ndarray] = []
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    held: list[np.ndarray] = []
    size = 0

    def flush() -> None:
        nonlocal number, held, size
        if not held:
            return
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        flat = hashes[np.concatenate(held)] if size else np.zeros(0, np.uint64)
        sums = sum(flat[k : len(flat) - WORDS + 1 + k] * _FACTORS[k] for k in range(WORDS)) if len(flat) >= WORDS else np.zeros(0, np.uint64)
        sums = mixed(sums)
        at = 0
        for ids in held:
            n = len(ids)
            if n >= WORDS:
                out.append(np.unique(sums[at : at + n - WORDS + 1]))
            elif n:
                out.append(mixed((flat[at : at + n] * _FACTORS[:n]).sum(keepdims=True) + _LENGTHS[n]))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        number = defaultdict()
        number.default_factory = number.__len__
        held, size = [], 0

    for text in texts:
        # bytes.lower() and bytes.split() take just A-Z and just ASCII white space
        words = text.encode().lower().split() if text else []
        held.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        size += len(words)
        if size >= BLOCK_WORDS:
            flush()
    flush()
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin, densified; shingles are sorted and not empty."""
    bins = (shingles >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    out = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    out[bins[first]] = shingles[first]
    full[bins[first]] = True
    if len(first) == 1:
        out[:] = shingles[0]
        return out
    empty = np.flatnonzero(~full)
    for leads in _LEADS:
        if not len(empty):
            return out
        to = leads[empty]
        found = full[to]
        out[empty[found]] = out[to[found]]
        empty = empty[~found]
    there = np.flatnonzero(full)
    out[empty] = out[there[np.searchsorted(there, empty) % len(there)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    rows = sig[: BANDS * BAND_BINS].reshape(BANDS, BAND_BINS)
    key = _BAND_SEEDS.copy()
    for k in range(BAND_BINS):
        key = mixed(key ^ rows[:, k])
    return key.view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_key binary, bands array<long>, text_key long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_key, which finds a text again."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def signed(docs: DataFrame) -> DataFrame:
    """Each document's number of shingles, a 128-bit key of its set, and its buckets."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(batch["text"].to_pylist())
            return {
                "doc_id": batch["doc_id"], "n_shingles": [len(s) for s in sets], "set_key": list(map(digest, sets)),
                "bands": [band_keys(signature(s)) if len(s) else [] for s in sets], "text_key": batch["text_key"],
            }

        return fn

    return arrow_map(keyed(docs), make, SIGNED)


def bitmap(shingles: np.ndarray) -> bytes:
    """One bit for each hash, by its lowest bits."""
    bits = np.zeros(BITS, np.uint8)
    bits[(shingles & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, shingles, bits) of the classes of wanted(rep, set_key, doc_id, text_key)."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            sets = shingle_sets(batch["text"].to_pylist())
            # a text of another class with this doc_id and text_key isn't it
            own = [i for i, (s, k) in enumerate(zip(sets, batch["set_key"].to_pylist(), strict=True)) if digest(s) == k]
            reps = batch["rep"].to_pylist()
            return {"rep": [reps[i] for i in own], "shingles": [sets[i].view(np.int64) for i in own], "bits": [bitmap(sets[i]) for i in own]}

        return fn

    place = ["doc_id", "text_key"]
    picked = keyed(docs).join(wanted, place).drop(*place).dropDuplicates(["rep"])
    return arrow_map(picked, make, "rep long, shingles array<long>, bits binary")


def bounded_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) within a group, of different labels, whose bitmaps allow a link.

    rows(key, part, rep, label, n, bits, met): key and part name a group, met is its number
    of rows. A group is cut into blocks by a hash of rep, and each two blocks are gone through
    together.
    """
    blocks = F.ceil(F.col("met") / BLOCK_CLASSES).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    cut = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    group = ["key", "part", "i", "j"]
    cut = cut.select("key", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label", "n", "bits")
    cut = cut.repartition(*group).sortWithinPartitions(*group, "rep")

    def compared(batch: pa.RecordBatch) -> list[tuple[int, int]]:
        rep, label, n, own = (batch[k].to_numpy() for k in ("rep", "label", "n", "own"))
        bits = np.frombuffer(b"".join(batch["bits"].to_pylist()), np.uint64).reshape(len(n), -1)
        spare = n - np.bitwise_count(bits).sum(axis=1)
        across = batch["i"][0] != batch["j"][0]
        out = []
        for x in range(len(n) - 1):
            may = (label[x + 1 :] != label[x]) & (100 * np.minimum(n[x + 1 :], n[x]) >= SIMILARITY * np.maximum(n[x + 1 :], n[x]))
            if across:
                may &= own[x + 1 :] != own[x]
            at = np.flatnonzero(may) + x + 1
            if len(at):
                most = np.bitwise_count(bits[at] & bits[x]).sum(axis=1) + np.minimum(spare[at], spare[x])
                out += [(int(rep[x]), int(rep[y])) for y in at[100 * most >= SIMILARITY * (n[at] + n[x] - most)]]
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def emit() -> pa.RecordBatch:
            out = record_batch({"a": [a for a, _ in seen], "b": [b for _, b in seen]}, "a long, b long")
            seen.clear()
            return out

        for whole in groups_of(batches, group):
            seen.update(compared(whole))
            if len(seen) >= 100_000:
                yield emit()
        if seen:
            yield emit()

    return map_batches(cut, run, "a long, b long").distinct()


def groups_of(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as a batch for each value of the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and values[a] != last:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough. Edges of one a lie together, in
    groups of about STAR_EDGES, and a's set is sent once for each."""
    size = written(edges.groupBy("a").agg(F.count("*").alias("edges")))
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("edges") / STAR_EDGES)).cast("int")
    groups = written(edges.join(size, "a").select("a", salt.alias("salt"), "b"))
    full = sets.select("rep", "shingles")
    centres = groups.select("a", "salt").distinct().join(full, F.col("a") == F.col("rep")).select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    others = groups.join(full, F.col("b") == F.col("rep")).select("a", "salt", "b", "shingles")
    both = centres.unionByName(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.int64)
        for batch in batches:
            values, found = batch["shingles"].flatten().to_numpy(), []
            ends = np.cumsum(batch["shingles"].value_lengths().to_numpy())
            for a, b, end, n in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), ends, np.diff(ends, prepend=0), strict=True):
                own = values[end - n : end]
                if b is None:
                    mine = own
                    continue
                common = len(np.intersect1d(mine, own, assume_unique=True))
                if 100 * common >= SIMILARITY * (len(mine) + len(own) - common):
                    found.append((a, b))
            if found:
                yield record_batch({"a": [a for a, _ in found], "b": [b for _, b in found]}, "a long, b long")

    return map_batches(both, run, "a long, b long")


def rare_parts(sets: DataFrame) -> DataFrame:
    """(rep, part) of the classes (rep, shingles) that share a rare shingle with another; part
    is the same for all that such shingles connect.

    Sets in one order of shingles, the rarest first, of which SIMILARITY hundredths are common
    have one in common among the first n - SIMILARITY * n / 100 + 1 of either.
    """
    each = sets.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    # shingles of one class alone come first in the order and connect nothing
    often = written(each.groupBy("shingle").agg(F.count("*").alias("f")).filter("f > 1"))
    own = Window.partitionBy("rep")
    ranked = each.join(often, "shingle").withColumn("rank", F.row_number().over(own.orderBy("f", "shingle"))).withColumn("shared", F.count("*").over(own))
    first = F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1
    rare = written(ranked.filter(F.col("rank") + F.col("n") - F.col("shared") <= first).select("rep", "shingle"))
    least = written(rare.groupBy("shingle").agg(F.min("rep").alias("a"), F.count("*").alias("f")).filter("f > 1").drop("f"))
    edges = rare.join(least, "shingle").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()
    return components(edges).select(F.col("node").alias("rep"), F.col("root").alias("part"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node that it reaches.

    Large-star and small-star steps hang each node on the least of its neighbours until
    nothing changes, in a number of steps that grows with the logarithm of the longest path.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            tops = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # a hub's join can then be split
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct())


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(rep, label) after the links (a, b) between reps."""
    a = labels.select(F.col("rep").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("rep").alias("b"), F.col("label").alias("lb"))
    roots = components(links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    roots = roots.select(F.col("node").alias("label"), "root")
    return written(labels.join(roots, "label", "left").select("rep", F.coalesce("root", "label").alias("label")))


def class_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, label) of the classes (rep, set_key, doc_id, text_key, n, bands) that share a
    bucket with another: the smallest rep of each one's component."""
    rows = classes.select("rep", "n", F.explode("bands").alias("key"))
    # the small sides of joins are written first, so that a join's own shuffle meets a hot
    # bucket, which adaptive execution then splits
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("met")).filter("met > 1"))
    live = written(rows.join(sizes, "key"))
    met = live.groupBy("rep").agg(F.sum("met").alias("met"))
    live = written(live.drop("met").join(met, "rep"))
    labels = written(live.select("rep", F.col("rep").alias("label")).distinct())
    sets = written(sets_of(docs, classes.join(labels, "rep", "left_semi").select("rep", "set_key", "doc_id", "text_key")))
    near = (100 * F.least("n", "cn") >= SIMILARITY * F.greatest("n", "cn")) & (F.col("label") != F.col("cl")) & (F.col("rep") != F.col("c"))
    several = [F.min("label").alias("low"), F.max("label").alias("high")]
    for _ in range(STARS):
        held = live.join(labels, "rep")
        top = F.max(F.struct("met", (-F.col("rep")).alias("last"), "rep", "n", "label")).alias("top")
        stars = held.groupBy("key").agg(top, *several).filter("low < high")
        stars = written(stars.select("key", F.col("top.rep").alias("c"), F.col("top.n").alias("cn"), F.col("top.label").alias("cl")))
        starred = written(held.join(stars, "key"))
        edges = written(starred.filter(near).select(F.col("c").alias("a"), F.col("rep").alias("b")).distinct())
        labels = relabelled(labels, written(verified(edges, sets)))
        live = starred.filter("rep <> c").select("key", "rep", "n", "met")
    left = left_pairs(live, labels, sets)
    return relabelled(labels, written(verified(written(bounded_pairs(left)), sets)))


def left_pairs(live: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows for bounded_pairs(): of the buckets in which several labels still meet, the classes
    that share rare shingles with one of another label."""
    several = [F.min("label").alias("low"), F.max("label").alias("high")]
    held = written(live.select("key", "rep", "n").join(labels, "rep"))
    mixed = written(held.groupBy("key").agg(*several).filter("low < high").select("key"))
    left = written(held.join(mixed, "key"))
    some = sets.join(left.select("rep").distinct(), "rep", "left_semi")
    left = written(left.join(rare_parts(some), "rep"))
    groups = written(left.groupBy("key", "part").agg(F.count("*").alias("met"), *several).filter("low < high").select("key", "part", "met"))
    return left.join(groups, ["key", "part"]).join(sets.select("rep", "bits"), "rep")


def shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) of classes whose texts share a doc_id."""
    key = F.xxhash64("set_key")
    several = rows.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).filter("low < high")
    reps = rows.join(written(several.select("doc_id")), "doc_id", "left_semi").select("doc_id", "set_key").distinct().join(classes.select("set_key", "rep"), "set_key")
    reps = written(reps.select("doc_id", "rep"))
    return reps.join(reps.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id that links of 0.75 or more reach. Null, empty and
    wordless texts have no shingles and are linked with nothing; a doc_id of null links
    nothing and is kept. Rows that share a doc_id are one document to their links.
    """
    rows = written(signed(docs))
    known = rows.filter("doc_id is not null and n_shingles > 0")
    classes = known.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    # numbered once: what is written stays
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "set_key", "least.*", "n", "bands"))
    labels = class_links(docs, classes)
    labels = classes.select("rep").join(labels, "rep", "left").select("rep", F.coalesce("label", "rep").alias("label"))
    if not (links := written(shared_ids(known, classes))).isEmpty():
        labels = relabelled(written(labels), links)
    placed = written(classes.select("rep", "set_key", "doc_id").join(labels, "rep").select("set_key", "label", "doc_id"))
    least = placed.groupBy("label").agg(F.min("doc_id").alias("root"))
    roots = written(placed.join(least, "label").select("set_key", "root"))
    out = rows.select("doc_id", "n_shingles", "set_key")
    blank = rows.filter("doc_id is not null and n_shingles = 0").select("doc_id").distinct()
    owner = written(known.join(blank, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("set_key").alias("owner")))
    if not owner.isEmpty():  # a text without shingles whose doc_id another text has
        out = out.join(owner, "doc_id", "left").withColumn("set_key", F.coalesce("set_key", "owner"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = out.join(roots, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b
), c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
