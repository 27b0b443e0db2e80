"""The prefix tree of conversations, from their sorted order.

Distinct conversations, as the digests of their turns, are sorted into blocks. The turns that
each has in common with the one before it (its LCP) make a Cartesian tree: the nearest smaller
values to the left and to the right of an LCP bound the conversations below one branching node,
and equal LCPs between the same bounds are one node. Blocks find these values by themselves,
with a stack; where they lie in other blocks, the least LCP of each block says in which, and
the block's own left or right outline, its running minima from either end, says where. What a
node counts is a difference of sums before its two bounds. Depths between a node and its
parent have the same conversations and are filled in at the end.

Turns are told apart by 128 bits of SHA-256. A conversation's digests (not its texts) are held
by a task, as is a block: 50,000 conversations, or a 100,000th of all, if that is more.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, record_batch, ship, table, written

#: Conversations of a block and the most blocks.
BLOCK, BLOCKS = 50_000, 100_000

#: Conversation ids that stand in one string where a group's ids are put together.
PIECE = 4_096

#: Hex digits of a turn's digest.
DIGITS = 32

NOTHING = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): digest and length of each turn, by turn, null first; turns of one
    number stand in the order of their digests. Rows without conv_id belong to none."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGITS)
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return conversations.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def grafted(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation with its first turns taken from the one whose number is the multiple of
    every below it: as many as the CRC of its number, modulo most."""
    heads = own.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("template"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    rows = own.withColumn("template", F.col("conv_id") - F.col("conv_id") % every).join(heads, "template", "left")
    first = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), h)).otherwise(F.slice("turns", 1, 0))
    return rows.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, chars): the digests of all turns as one string, and their lengths."""
    part = lambda name: F.transform("turns", lambda t: t[name])
    return conversations.select("conv_id", F.array_join(part("digest"), "").alias("seq"), part("chars").alias("chars"))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted (sid, conv_id): the digest of each group that lies within, and the first and
    the last group, which may go on elsewhere, as pieces."""
    schema = "sid string, first long, ids string, ends_sha256 string"
    out, sid, ids, pieces, opening = [], None, [], [], True

    def close(last: bool) -> None:
        nonlocal opening
        if opening or last:
            out.extend((sid, first, text, None) for first, text in pieces)
            if ids:
                out.append((sid, ids[0], ",".join(map(str, ids)), None))
        elif pieces or len(ids) > 1:
            sha = hashlib.sha256()
            for i, (_, text) in enumerate(pieces):
                sha.update((("," if i else "") + text).encode())
            sha.update(((("," if pieces else "") + ",".join(map(str, ids))) if ids else "").encode())
            out.append((sid, pieces[0][0] if pieces else ids[0], None, sha.hexdigest()))
        opening = False

    def flush() -> pa.RecordBatch:
        done = record_batch(dict(zip(schema.replace(",", "").split()[::2], map(list, zip(*out)), strict=True)), schema)
        out.clear()
        return done

    for batch in batches:
        for s, c in zip(batch["sid"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if s != sid:
                if sid is not None:
                    close(False)
                sid, ids, pieces = s, [], []
            ids.append(c)
            if len(ids) == PIECE:
                piece = ids[0], ",".join(map(str, ids))
                ids = []
                if opening:  # this group goes out in pieces anyway
                    out.append((sid, *piece, None))
                else:
                    pieces.append(piece)
        if out:
            yield flush()
    if sid is not None:
        close(True)
    if out:
        yield flush()


def ends(rows: DataFrame) -> DataFrame:
    """(conv, ends_sha256): the digest of the ascending ids of each group of several equal
    conversations, by its least id. Groups are cut by ranges of ids; what a digest, which can't
    be split, takes in one task are strings of 4,096 ids, one after the other."""
    sid = F.substring(F.sha2("seq", 256), 1, DIGITS).alias("sid")
    ranged = rows.select(sid, "conv_id").repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    found = written(map_batches(ranged, _runs, "sid string, first long, ids string, ends_sha256 string"))
    schema = "conv long, ends_sha256 string"

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid = first = sha = None
        for batch in batches:
            out = {"conv": [], "ends_sha256": []}
            for s, f, ids in zip(*(batch[c].to_pylist() for c in ("sid", "first", "ids")), strict=True):
                if s != sid:
                    if sha:
                        out["conv"].append(first)
                        out["ends_sha256"].append(sha.hexdigest())
                    sid, first, sha = s, f, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield record_batch(out, schema)
        if sha:
            yield record_batch({"conv": [first], "ends_sha256": [sha.hexdigest()]}, schema)

    cut = found.filter("ids is not null").select("sid", "first", "ids").repartition("sid").sortWithinPartitions("sid", "first")
    return found.filter("ids is null").select(F.col("first").alias("conv"), "ends_sha256").unionByName(map_batches(cut, digests, schema))


def common_turns(a: str, b: str) -> int:
    """How many turns two sequences have in common at their start."""
    n = min(len(a), len(b)) // DIGITS
    lo, hi = 0, n
    while lo < hi:  # the longest common prefix, by halving
        mid = (lo + hi + 1) // 2
        if a[: mid * DIGITS] == b[: mid * DIGITS]:
            lo = mid
        else:
            hi = mid - 1
    return lo


SORTED = "block int, idx long, lcp long, size long, n long, conv long, ends_sha256 string, sums array<long>, w long, leaf long, edge string"


def _with_lcps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LCPs of a block's rows but the first, whether a row but the last is a leaf, sums of
    lengths, and what each adds to the sum that saved tokens are taken from."""
    names = SORTED.replace(",", "").split()[::2]
    held, before, idx = None, None, 0
    for batch in batches:
        out = []
        for block, seq, n, conv, ends_, chars in zip(*(batch[c].to_pylist() for c in ("block", "seq", "n", "conv", "ends_sha256", "chars")), strict=True):
            lcp = None if before is None else common_turns(before, seq)
            if held:
                held[9] = int(lcp < held[3])
                out.append(held)
            sums = [0, *accumulate(chars)]
            held = [block, idx, lcp, len(chars), n, conv, ends_, sums, (n - 1) * sums[-1] + sums[lcp or 0], None, seq if before is None else None]
            before, idx = seq, idx + 1
        if out:
            yield record_batch(dict(zip(names, map(list, zip(*out)), strict=True)), SORTED)
    if held:
        held[10] = before
        yield record_batch({k: [v] for k, v in zip(names, held, strict=True)}, SORTED)


class Blocks:
    """A row of numbers for each block that has rows: 100,000 at most."""

    def __init__(self, ids, least, conv, counts, leaves, w, first_lcp, first_sum, children):
        self.ids, self.least, self.conv = ids, np.array(least, np.int64), np.array(conv, np.int64)
        self.first_lcp, self.first_sum, self.children = first_lcp, dict(zip(ids, first_sum, strict=True)), children
        self.before = [dict(zip(ids, [0, *accumulate(x)][:-1], strict=True)) for x in (counts, leaves, w)]
        self.totals = tuple(sum(x) for x in (counts, leaves, w))
        self.at = {b: i for i, b in enumerate(ids)}

    def after(self, block: int) -> int:
        """The first LCP of the next block; below all after the last one."""
        i = self.at[block] + 1
        return self.first_lcp[i] if i < len(self.ids) else -1

    def left(self, block: int, depth: int) -> int:
        """The nearest block before this one with an LCP below depth: the first has one."""
        return self.ids[int(np.flatnonzero(self.least[: self.at[block]] < depth)[-1])]

    def right(self, block: int, depth: int) -> int | None:
        found = np.flatnonzero(self.least[self.at[block] + 1 :] < depth)
        return self.ids[self.at[block] + 1 + int(found[0])] if len(found) else None

    def least_conv(self, first: int, last: int | None) -> int:
        """The least conversation of the blocks between two."""
        part = self.conv[self.at[first] + 1 : len(self.ids) if last is None else self.at[last]]
        return int(part.min()) if len(part) else np.iinfo(np.int64).max


class _Open:
    """A node of one depth, and the last row whose LCP is that depth."""

    __slots__ = ("depth", "row", "equal", "all", "last", "conv", "key")

    def __init__(self, depth: int, row: tuple, conv: int):
        self.depth, self.row, self.equal, self.all, self.last = depth, row, 1, conv, conv
        self.conv, self.key = None, None


NODE = (
    "kind string, block int, depth long, parent_block int, parent_depth long, conv long, parent_conv long, n long, n_leaves long, n_children long, "
    "base long, sums array<long>, end_n long, end_conv long, end_sha256 string, lcp long, size long, least long"
)
_NAMES = NODE.replace(",", "").split()[::2]


class _Nodes:
    """One block's nodes: closed ones, parts of those that other blocks share, and outlines."""

    def __init__(self, block: int, blocks: Blocks):
        self.block, self.blocks, self.stack, self.out, self.waiting = block, blocks, [], [], []
        self.sums = tuple(b[block] for b in blocks.before)
        self.least, self.held, self.lowest = None, None, None

    def emit(self, **values) -> None:
        self.out.append([values.get(k) for k in _NAMES])

    def key(self, depth: int, within: bool) -> tuple[int, int]:
        return (self.block if within else self.blocks.left(self.block, depth), depth)

    def closed(self, depth: int, row: tuple, conv: int, equal: int, sums: tuple, lcp: int, parent: _Open | None) -> None:
        """A node from row to before the row with these sums and this LCP; the root isn't one."""
        if depth <= 0:
            return
        at, size, n, own, ends_, lengths, (n0, l0, w0) = row
        low = max(at, lcp, 0)
        values = dict(
            kind="node", block=self.block, depth=depth, parent_depth=low, conv=conv, n=sums[0] - n0, n_leaves=sums[1] - l0,
            n_children=equal + 1 - (size == depth) if equal else 0, base=sums[2] - w0 - lengths[max(at, 0)], sums=lengths[low:depth],
        )
        if size == depth:
            values |= dict(end_n=n, end_conv=own, end_sha256=ends_)
        self.waiting.append((values, parent if low else None))

    def pop_above(self, lcp: int, sums: tuple, new: _Open) -> None:
        """Closes what is deeper than lcp at the row with these sums."""
        while self.stack and self.stack[-1].depth > lcp:
            top = self.stack.pop()
            if self.stack:
                below = self.stack[-1]
                top.conv = min(below.last, top.all)
                self.closed(top.depth, below.row, top.conv, top.equal, sums, lcp, below if below.depth >= lcp else new)
                below.all, below.last = min(below.all, top.all), min(below.last, top.all)
            else:
                top.key = self.key(top.depth, False)
                self.shared(top)

    def shared(self, node: _Open) -> None:
        if node.depth > 0:
            self.emit(kind="open", block=node.key[0], depth=node.depth, n_children=node.equal)

    def outline(self, kind: str, row: tuple, least: int) -> None:
        at, size, n, own, ends_, lengths, (n0, l0, w0) = row
        self.emit(kind=kind, block=self.block, depth=at, n=n0, n_leaves=l0, base=w0, lcp=at, size=size, sums=lengths if kind == "right" else None, end_n=n, end_conv=own, end_sha256=ends_, least=least)

    def add(self, lcp: int, size: int, n: int, conv: int, ends_: str | None, lengths: list[int], leaf: int, w: int) -> None:
        row = (lcp, size, n, conv, ends_, lengths, self.sums)
        new = _Open(lcp, row, conv)
        self.leaf(lcp, new)
        self.pop_above(lcp, self.sums, new)
        if self.lowest is None or lcp < self.lowest:
            self.outline("left", row, self.least)
            self.lowest = lcp
        self.least = conv if self.least is None else min(self.least, conv)
        if self.stack and self.stack[-1].depth == lcp:
            top = self.stack[-1]
            top.row, top.equal, top.all, top.last = row, top.equal + 1, min(top.all, conv), conv
        else:
            self.stack.append(new)
        self.held = (row, leaf)
        self.sums = (self.sums[0] + n, self.sums[1] + leaf, self.sums[2] + w)

    def leaf(self, lcp: int, new: _Open) -> None:
        """The row before, as a node of its own where it isn't the start of the next."""
        if self.held and self.held[1] and self.held[0][1]:
            row, top = self.held[0], self.stack[-1]
            self.closed(row[1], row, row[3], 0, self.sums, lcp, top if top.depth >= lcp else new)

    def finish(self) -> list[list]:
        after = self.blocks.after(self.block)
        if not self.stack:
            return self.out
        new = _Open(after, (), 0)
        new.key = (self.block, after)  # its nearest smaller value on the left, unless none is here
        least = np.iinfo(np.int64).max
        outline = []
        for node in reversed(self.stack):
            if node.depth < after:
                outline.append((node.row, min(least, node.last)))
            least = min(least, node.all)
        self.leaf(after, new)
        self.pop_above(after, self.sums, new)
        for row, low in outline:
            self.outline("right", row, low)
        for i, node in enumerate(self.stack):
            node.key = self.key(node.depth, i > 0) if node.depth > 0 else None
            if node.key:
                self.shared(node)
        if after > 0 and not any(node.depth < after for node in self.stack):
            new.key = self.key(after, False)
        for values, parent in self.waiting:
            if parent is not None:
                values["parent_conv"] = parent.conv
                if parent.conv is None:
                    values["parent_block"] = parent.key[0]
            self.emit(**values)
        return self.out


def _summed(t: DataFrame) -> Blocks:
    """The numbers of each block, and the LCP of its first row with the last one before."""
    ship(t.sparkSession)
    sums = [F.min("lcp"), F.min("conv"), F.sum("n"), F.sum("leaf"), F.sum("w"), F.count_if(F.col("lcp") == 0)]
    rows = sorted(map(tuple, t.groupBy("block").agg(*sums).collect()))
    ids = [r[0] for r in rows]
    edges = t.filter("edge is not null")
    last = edges.groupBy("block").agg(F.max_by("size", "idx").alias("size"), F.max_by("edge", "idx").alias("last"))
    sizes = dict(map(tuple, last.select("block", "size").collect()))
    first = {}
    if len(ids) > 1:
        then = F.broadcast(t.sparkSession.createDataFrame(list(zip(ids, ids[1:])), "before int, block int"))
        heads = edges.filter("idx = 0").select("block", "edge", "sums").join(then, "block")
        pairs = heads.join(last.withColumnRenamed("block", "before"), "before")
        lcp = F.arrow_udf(lambda a, b: pa.array(list(map(common_turns, a.to_pylist(), b.to_pylist())), pa.int64()), "bigint")
        found = pairs.select("block", "sums", lcp("last", "edge").alias("lcp"))
        first = {b: (v, s) for b, v, s in found.select("block", "lcp", F.get("sums", F.col("lcp"))).collect()}
    lcps, starts = zip(*(first.get(b, (-1, 0)) for b in ids)) if ids else ((), ())
    least = [min(x for x in (r[1], v) if x is not None) for r, v in zip(rows, lcps, strict=True)]
    leaves = [(r[4] or 0) + (after < sizes[r[0]]) for r, after in zip(rows, [*lcps[1:], -1], strict=False)]
    w = [r[5] + s for r, s in zip(rows, starts, strict=True)]
    children = sum(r[6] for r in rows) + sum(v == 0 for v in lcps)
    return Blocks(ids, least, [r[2] for r in rows], [r[3] for r in rows], leaves, w, lcps, starts, children)


def _of_blocks(t: DataFrame, blocks: Blocks) -> DataFrame:
    """Each block's nodes, shared nodes' parts and outlines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = None

        def done() -> Iterator[pa.RecordBatch]:
            out = nodes.finish() if nodes else []
            for i in range(0, len(out), 5_000):
                yield record_batch(dict(zip(_NAMES, map(list, zip(*out[i : i + 5_000])), strict=True)), NODE)

        names = ("block", "idx", "lcp", "size", "n", "conv", "ends_sha256", "sums", "w", "leaf")
        for batch in batches:
            for block, idx, lcp, size, n, conv, ends_, sums, w, leaf in zip(*(batch[c].to_pylist() for c in names), strict=True):
                if nodes is None or nodes.block != block:
                    yield from done()
                    nodes = _Nodes(block, blocks)
                    lcp, w = blocks.first_lcp[blocks.at[block]], w + blocks.first_sum[block]
                nodes.add(lcp, size, n, conv, ends_, sums, int(blocks.after(block) < size) if leaf is None else leaf, w)
        yield from done()

    return map_batches(t.drop("edge").repartition("block").sortWithinPartitions("block", "idx"), run, NODE)


def _looked_up(queries: DataFrame, at: str, outline: DataFrame, name: str) -> DataFrame:
    """The row of a block's outline with the greatest LCP below each query's depth."""
    held = outline.select(F.col("block").alias(at), "depth", F.lit(1).alias("_found"), F.struct("n", "n_leaves", "base", "lcp", "size", "sums", "end_n", "end_conv", "end_sha256", "least").alias(name))
    rows = queries.withColumn("_found", F.lit(0)).unionByName(held, allowMissingColumns=True)
    order = Window.partitionBy(at).orderBy("depth", "_found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(name, ignorenulls=True).over(order)).filter("_found = 0").drop("_found")


def _across(parts: DataFrame, blocks: Blocks) -> DataFrame:
    """Nodes that several blocks share: the parts of one node are those with the same block of
    its left bound and the same depth."""
    total, most = blocks.totals, np.iinfo(np.int64).max

    def right(block: pa.Array, depth: pa.Array) -> pa.Array:
        return pa.array([blocks.right(*x) for x in zip(block.to_pylist(), depth.to_pylist(), strict=True)], pa.int32())

    def between(block: pa.Array, last: pa.Array) -> pa.Array:
        return pa.array([blocks.least_conv(*x) for x in zip(block.to_pylist(), last.to_pylist(), strict=True)], pa.int64())

    def owner(block: pa.Array, depth: pa.Array) -> pa.Array:
        keys = zip(block.to_pylist(), depth.to_pylist(), strict=True)
        return pa.array([None if d <= 0 else b if blocks.least[blocks.at[b]] < d else blocks.left(b, d) for b, d in keys], pa.int32())

    shared = parts.filter("kind = 'open'").groupBy("block", "depth").agg(F.sum("n_children").alias("equal"))
    shared = shared.withColumn("last", F.arrow_udf(right, "int")("block", "depth"))
    shared = _looked_up(shared, "block", parts.filter("kind = 'right'"), "l")
    shared = _looked_up(shared.withColumn("middle", F.arrow_udf(between, "bigint")("block", "last")), "last", parts.filter("kind = 'left'"), "r")
    end = lambda name, other: F.when(F.col("last").isNull(), F.lit(other)).otherwise(F.col(f"r.{name}"))
    low = F.greatest("l.lcp", end("lcp", -1), F.lit(0))
    whole = F.col("l.size") == F.col("depth")
    rows = shared.withColumn("parent_depth", low)
    return rows.select(
        "block", "depth", F.arrow_udf(owner, "int")("block", "parent_depth").alias("parent_block"), "parent_depth",
        F.least("l.least", "middle", F.coalesce(end("least", most), F.lit(most))).alias("conv"),
        (end("n", total[0]) - F.col("l.n")).alias("n"), (end("n_leaves", total[1]) - F.col("l.n_leaves")).alias("n_leaves"),
        (F.col("equal") + 1 - whole.cast("int")).alias("n_children"),
        (end("base", total[2]) - F.col("l.base") - F.get("l.sums", F.greatest("l.lcp", F.lit(0)))).alias("base"),
        F.slice("l.sums", F.col("parent_depth").cast("int") + 1, (F.col("depth") - F.col("parent_depth")).cast("int")).alias("sums"),
        *[F.when(whole, F.col(f"l.{c}")).alias(c) for c in ("end_n", "end_conv", "end_sha256")],
    )


def _root(t: DataFrame, blocks: Blocks) -> DataFrame:
    top = t.filter((F.col("block") == (blocks.ids[0] if blocks.ids else -1)) & (F.col("idx") == 0))
    turnless = F.col("size") == 0
    lits = dict(conv_id=int(blocks.conv.min()) if blocks.ids else 0, depth=0, parent_conv_id=None, n_convs=blocks.totals[0])
    children = F.lit(blocks.children + 1).cast("long") - turnless.cast("int")
    return top.select(
        *[F.lit(v).cast("long").alias(k) for k, v in lits.items()], children.alias("n_children"), F.lit(blocks.totals[1]).cast("long").alias("n_leaves"), F.lit(blocks.totals[2]).cast("long").alias("saved_tokens"),
        F.when(turnless, F.coalesce("ends_sha256", F.sha2(F.col("conv").cast("string"), 256))).otherwise(NOTHING).alias("ends_sha256"),
    )


def prefix_tree(rows: DataFrame) -> DataFrame:
    """Nodes of the prefix tree of (conv_id, seq, chars), as sequences() gives them.

    Per node: its least conversation, depth, its parent's least conversation (null for the
    root), how many conversations, children and leaves are below, what sharing the turns of
    its subtree saves in code points, and the digest of the conversations that end there. No
    conversations make no nodes; with any, the root has all.
    """
    rows = written(rows)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(BLOCKS, -(-rows.count() // BLOCK)))
    one = rows.groupBy("seq", "chars").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n"))
    one = one.join(ends(rows), "conv", "left").repartitionByRange(n, "seq").sortWithinPartitions("seq")
    t = written(map_batches(one.select(F.spark_partition_id().alias("block"), "seq", "n", "conv", "ends_sha256", "chars"), _with_lcps, SORTED))
    blocks = _summed(t)
    parts = written(_of_blocks(t, blocks))
    shared = written(_across(parts, blocks))
    known = shared.select(F.col("block").alias("parent_block"), F.col("depth").alias("parent_depth"), F.col("conv").alias("above"))
    columns = ["depth", "parent_depth", "conv", "parent_conv", "n", "n_leaves", "n_children", "base", "sums", "end_n", "end_conv", "end_sha256"]
    own = parts.filter("kind = 'node'")
    # each block asks once for a node above, however many of its own hang from it
    asked = own.filter("parent_block is not null").select("block", "parent_block", "parent_depth").distinct().join(known, ["parent_block", "parent_depth"])
    own = own.join(asked, ["block", "parent_block", "parent_depth"], "left").withColumn("parent_conv", F.coalesce("parent_conv", "above"))
    over = shared.join(known, ["parent_block", "parent_depth"], "left").withColumn("parent_conv", F.col("above"))
    nodes = own.select(columns).unionByName(over.select(columns))
    nodes = nodes.select("*", F.size("sums").alias("span"), F.posexplode("sums").alias("i", "sum"))
    lowest = F.col("i") + 1 == F.col("span")
    root = F.lit(int(blocks.conv.min()) if blocks.ids else 0).cast("long")
    own_ends = F.coalesce("end_sha256", F.sha2(F.col("end_conv").cast("string"), 256), F.lit(NOTHING))
    found = nodes.select(
        F.col("conv").alias("conv_id"), (F.col("parent_depth") + 1 + F.col("i")).alias("depth"),
        F.when(F.col("i") > 0, F.col("conv")).when(F.col("parent_depth") == 0, root).otherwise(F.col("parent_conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(lowest, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("base") - (F.col("n") - 1) * F.col("sum")).alias("saved_tokens"), F.when(lowest, own_ends).otherwise(NOTHING).alias("ends_sha256"),
    )
    return found.unionByName(_root(t, blocks))


def op13_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null roles and texts count as empty; rows without conv_id belong to no conversation; turns
    of one number stand in the order of their digests, rows that repeat one after the other."""
    return prefix_tree(sequences(grafted(turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))))


OP13_SQL = f"""WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({{'d': left(sha256(length(role) || ':' || role || text), 32), 'c': length(text)}} ORDER BY turn NULLS FIRST, left(sha256(length(role) || ':' || role || text), 32)) AS turns FROM t GROUP BY 1
), h AS (
  SELECT conv_id, turns, (list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda a, x: xor(a // 256, list_reduce(list_prepend(xor(a % 256, x), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END)))) AS state FROM own
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:xor(a.state, 4294967295) % 6], []), a.turns[xor(a.state, 4294967295) % 6 + 1:]) AS turns
  FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), prefixes AS (
  SELECT conv_id, d, array_to_string(list_transform(turns[1:d], lambda x: x.d), '') AS k, CASE WHEN d > 0 THEN turns[d].c ELSE 0 END AS c, len(turns) = d AS ended
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(c) AS c, coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE ended), '') AS ends FROM prefixes GROUP BY 1, 2
), kids AS (
  SELECT left(k, length(k) - 32) AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1
), below AS (
  SELECT left(k, 32 * a) AS k, sum((n_convs - 1) * c)::bigint AS saved_tokens, count(*) FILTER (WHERE k NOT IN (SELECT k FROM kids)) AS n_leaves
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM node) GROUP BY 1
)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN node up ON node.d > 0 AND up.k = left(node.k, length(node.k) - 32)
"""
