"""Main text of web pages by differencing each page against its nearest neighbour.

A page becomes lines, one for each block of text. Pages are sorted by host and URL path over
the whole table, in ranges, so that a host with a third of all pages lies in many tasks. Of
the two pages beside it on its host, a page is paired with the one that shares the longer
start of its path. Pages of a host with equal lines stand in that order once, and a neighbour
that has nearly all of a page's text is a copy and no pair. The pair's lines are aligned by a
longest common subsequence, and lines in it are the host's furniture and go.

Differencing alone finds what pages of a host share, and neither menus nor comments that are
other ones on each page (see the README for figures), so elements that say what they are go
before it: what stands in navigation, headers, footers, sidebars, forms and the like, or in a
container named as an advert, a notice or reader comments, goes whether shared or not, and if
a page has an article or main element, its lines are the text whether shared or not and all
others go. Without labels, which is a choice of main_text(), the pairs decide alone.
"""

from __future__ import annotations

import html as entities
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import arrow_map, map_batches, record_batch, table, written

#: A comment, a raw element with all it holds, a tag, or the start of one at the page's end.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|select|svg|title)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)"
    r"|<[a-zA-Z/!?](?:\"[^\"]*\"|'[^']*'|[^'\">])*+>|<[a-zA-Z/!?][^<>]*(?:>|\Z)",
    re.S | re.I,
)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9-]*)")
NAMED = re.compile(r"""(?<=[\s"'/])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside form menu dialog button".split())
MAIN = frozenset("article main".split())
#: Words of a class, id or role that name furniture: of the page's layout, and others. A token
#: names furniture if it is such a word, or one with these words before or after it.
LAYOUT = frozenset("banner sidebar side nav navbar navigation menu breadcrumb breadcrumbs header masthead footer contentinfo complementary search social related recommended modal".split())
EXTRAS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion cookie cookies consent gdpr notice notices "
    "comment comments disqus replies newsletter subscribe signup login share popup alert".split()
)
BEFORE = frozenset("site global page main primary secondary top bottom left right upper lower inner outer sticky mobile desktop reader readers user users post article".split())
AFTER = frozenset("item items list links link bar box slot unit area block widget container wrapper wrap inner section buttons button form top bottom left right posts articles".split())
#: What of these may stand before header: an article's header, or a page's, has its title.
HEADERS, BEFORE_HEADER = frozenset("header masthead".split()), frozenset("site global top".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@lru_cache(4096)
def _names(attribute: str, value: str, inside: bool) -> tuple[bool, bool]:
    """Whether a value names furniture, and whether by words of layout alone. inside an
    article a header is none, as the element of that name."""
    value = value.lower().replace("_", "-")
    found = layout = False
    for token in value.split() if attribute in ("class", "role") else ["-".join(value.split())]:
        parts = [x for x in token.split("-") if x]
        words = [x for x in parts if x in LAYOUT or x in EXTRAS]
        header = not HEADERS.isdisjoint(words)
        if not words or header and inside:
            continue
        first, last = parts.index(words[0]), len(parts) - 1 - parts[::-1].index(words[-1])
        before, between, after = parts[:first], parts[first : last + 1], parts[last + 1 :]
        if "side" in words and len(parts) > 1 or not set(between) <= set(words):
            continue
        if not set(before) <= (BEFORE_HEADER if header else BEFORE) or not all(x in AFTER or x.isdigit() for x in after):
            continue
        found, layout = True, set(words) <= LAYOUT and (layout or not found)
    return found, layout


def _named(tag: str, name: str, inside: bool) -> tuple[bool, bool]:
    """Whether a tag's class, id, role or label names furniture, and whether as layout alone."""
    if name in MAIN or name in HEADINGS or name in ("html", "body"):
        return False, False
    got = [_names(k.lower(), a or b or c, inside) for k, a, b, c in NAMED.findall(tag)]
    got = [layout for found, layout in got if found]
    return bool(got), bool(got) and all(got)


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


#: Share of a page's text from which an element is its wrapper, whatever its name.
WRAPPER = 0.75


def lines(page: str | None, labels: bool = True) -> tuple[list[str], list[bool], bool]:
    """A page's text blocks outside furniture, whether each lies in an article or main
    element, and whether the page has one. Without labels no element is furniture or main.

    A piece of unclosed furniture ends where an article or main element begins. An element
    that a name of layout makes furniture is none if it wraps most of the page's text.
    """
    out, inside, has_main, wrappers = _lines(page, frozenset(), labels)
    if wrappers:
        out, inside, has_main, _ = _lines(page, wrappers, labels)
    return out, inside, has_main


def _lines(page: str | None, spared: frozenset[int], labels: bool) -> tuple[list[str], list[bool], bool, frozenset[int]]:
    """lines(), and the places of the tags that wrap most of the text and are named as
    furniture; those in spared are none."""
    out: list[str] = []
    inside: list[bool] = []
    parts: list[str] = []
    stack: list[tuple[str, bool]] = []  # open elements, with whether each is furniture
    opened: list[tuple[int, int, int]] = []  # named ones: place, depth and characters before
    spans: list[tuple[int, int]] = []  # of each of them that ended: place and characters
    seen = 0
    hidden = mains = at = 0
    has_main = False

    def end(depth: int) -> None:
        while opened and opened[-1][1] >= depth:
            place, _, before = opened.pop()
            spans.append((place, seen - before))

    def close() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                out.append(text)
                inside.append(mains > 0)
            parts.clear()

    page = page or ""
    for m in MARKUP.finditer(page):
        if m.start() > at:
            seen += len(page[at : m.start()].strip())
            if not hidden:
                parts.append(page[at : m.start()])
        at = m.end()
        tag = m[0]
        if m[1] or tag.startswith("<!") or not (name := NAME.match(tag)):
            continue
        name = name[1].lower()
        if name not in BLOCKS and name not in FURNITURE and not NAMED.search(tag):
            if tag[1] == "/" and any(n == name for n, _ in stack):
                pass  # a named inline element that was put on the stack ends here
            else:
                if name == "br" or name == "img":
                    parts.append(" ")
                continue
        if name in BLOCKS:
            close()
        if tag[1] == "/":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if hidden:
                        parts.clear()
                    else:
                        close()
                    for n, furniture in stack[i:]:
                        hidden -= furniture
                        mains -= labels and n in MAIN
                    del stack[i:]
                    end(i)
                    break
            continue
        if name in VOID or tag.endswith("/>"):
            continue
        if labels and name in MAIN:
            has_main = True
            while hidden:
                n, furniture = stack.pop()
                hidden -= furniture
                mains -= n in MAIN
            end(len(stack))
        elif name == "p" or name == "li":
            if stack and stack[-1][0] == name:  # its end tag may be left out
                hidden -= stack.pop()[1]
                end(len(stack))
        named, layout = _named(tag, name, mains > 0) if labels else (False, False)
        if named and layout and name not in FURNITURE:
            if m.start() in spared:
                named = False
            elif not spared:
                opened.append((m.start(), len(stack), seen))
        furniture = labels and (name in FURNITURE or named or (name == "header" and not mains))
        stack.append((name, furniture))
        hidden += furniture
        mains += labels and name in MAIN
    if at < len(page):
        seen += len(page[at:].strip())
        if not hidden:
            parts.append(page[at:])
    close()
    end(0)
    return out, inside, has_main, frozenset(place for place, n in spans if n > WRAPPER * seen)


def common(a: list[int], b: list[int]) -> set[int]:
    """Places in a of a longest common subsequence with b.

    Bit-parallel: one step for each line of a, with a number of as many bits as b has lines.
    Only every k-th step's number is kept, and the others are found again on the way back.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    found = set(range(start)) | set(range(len(a) - end, len(a)))
    there = set(b[start : len(b) - end])
    rows = [i for i in range(start, len(a) - end) if a[i] in there]
    here = {a[i] for i in rows}
    columns = [x for x in b[start : len(b) - end] if x in here]
    if not rows:
        return found
    masks: dict[int, int] = {}
    for j, x in enumerate(columns):
        masks[x] = masks.get(x, 0) | 1 << j
    all_ = (1 << len(columns)) - 1

    def step(v: int, i: int) -> int:
        u = v & masks[a[rows[i]]]
        return ((v + u) | (v - u)) & all_

    k = max(1, int(len(rows) ** 0.5))
    held, v = [all_], all_
    for i in range(len(rows)):
        v = step(v, i)
        if (i + 1) % k == 0:
            held.append(v)
    i, j, low, part = len(rows), len(columns), len(rows) + 1, []

    def at(i: int) -> int:
        """The number after i steps."""
        nonlocal low, part
        if i < low:
            low = i // k * k
            part = [held[low // k]]
            for s in range(low, min(low + k, len(rows))):
                part.append(step(part[-1], s))
        return part[i - low]

    while i and j:
        if at(i) >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not at(i - 1) >> (j - 1) & 1:
            i -= 1
        else:
            found.add(rows[i - 1])
            i, j = i - 1, j - 1
    return found


def _place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; a page without URL has neither."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://)?([^/?#]*)([^?#]*)", url or "")
    return m[1].lower(), m[2]


def _shared(a: str, b: str | None) -> int:
    if b is None:
        return -1
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def hashed(line: str) -> int:
    """A signed number of 64 bits for a line: a hash, and in the lowest 8 bits its length."""
    return (xxhash.xxh64_intdigest(line.encode("utf-8", "replace")) & ~255 | min(255, len(line) // 8)) - (1 << 63)


def weight(hashes: list[int]) -> int:
    """About an eighth of the characters of lines, long lines counting as 2048."""
    return sum((x & 255) + 1 for x in hashes)


def digest(host: str, hashes: list[int], settled: bool) -> int:
    """One number for the lines of a page of a host."""
    return xxhash.xxh64_intdigest(host.encode("utf-8", "replace") + b"\0\1"[settled : settled + 1] + array("q", hashes).tobytes()) - (1 << 63)


KEYS = "page_id long, digest long, host string, path string, settled boolean, hashes array<long>"
#: Share of a page's text from which a neighbour that has it is a copy of the page.
COPY = 0.9


#: Lines of unsettled pages up to which their marks are sent to every task.
BROADCAST_LINES = 1_000_000


def keys(pages: DataFrame, labels: bool = True) -> DataFrame:
    """Host, path and line hashes of each page. digest is the same for a host's pages of equal
    lines; settled pages have a main element, and are neighbours but need no pair."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            places = [_place(u) for u in batch["url"].to_pylist()]
            parsed = [lines(h, labels) for h in batch["html"].to_pylist()]
            found = [[hashed(x) for x in blocks] for blocks, _, _ in parsed]
            digests = [digest(h, x, m) for (h, _), x, (_, _, m) in zip(places, found, parsed, strict=True)]
            return {
                "page_id": batch["page_id"], "digest": digests, "host": [h for h, _ in places], "path": [p for _, p in places],
                "settled": [m for _, _, m in parsed], "hashes": found,
            }

        return fn

    return arrow_map(pages, make, KEYS)


def neighbours(rows: DataFrame, ranges: int) -> DataFrame:
    """Adds before and after, the pages beside each in the order of host, path and page_id.

    The order is cut in ranges; the first and last pages of ranges, two for each, are handed
    to the ranges beside them.
    """
    order = ["host", "path", "page_id", "digest"]
    number = "part int, place int, last boolean, " + KEYS
    names = ("page_id", "digest", "host", "path", "settled", "hashes")

    def run(batches) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, at, held = context.partitionId() if context else 0, 0, None

        def made(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
            n = batch.num_rows
            columns = {"part": [part] * n, "place": list(range(at, at + n)), "last": [False] * (n - 1) + [last]}
            return record_batch(columns | {k: batch[k].to_pylist() for k in names}, number)

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield made(held, False)
                    at += held.num_rows
                held = batch
        if held is not None:
            yield made(held, True)

    ordered = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = written(map_batches(ordered.select(*names), run, number))
    page = F.struct("host", "path", "hashes")
    # two rows at most for each range, however many pages there are
    ends = placed.groupBy("part").agg(F.min(F.when(F.col("place") == 0, page)).alias("head"), F.min(F.when(F.col("last"), page)).alias("tail"))
    beside = Window.orderBy("part")
    ends = ends.select("part", F.lag("tail").over(beside).alias("earlier"), F.lead("head").over(beside).alias("later"))
    return placed.join(ends, "part")


def furniture(rows: DataFrame) -> DataFrame:
    """(digest, gone): for each line of an unsettled page whether its pair shares it."""
    schema = "digest long, gone array<boolean>"

    def run(batches) -> Iterator[pa.RecordBatch]:
        def pair(earlier: dict | None, page: dict, later: dict | None) -> list[bool]:
            n = len(page["hashes"])
            near = [x for x in (earlier, later) if x and x["host"] == page["host"] and page["host"]]
            for other in sorted(near, key=lambda x: -_shared(page["path"], x["path"])):
                shared = common(page["hashes"], other["hashes"])
                if weight([page["hashes"][i] for i in shared]) < COPY * weight(page["hashes"]):
                    return [i in shared for i in range(n)]
            return [False] * n

        def emit(out: list[tuple]) -> pa.RecordBatch:
            return record_batch(dict(zip(("digest", "gone"), zip(*out, strict=True), strict=True)), schema)

        earlier = now = None
        for batch in batches:
            out = []
            for page in batch.to_pylist():
                if now is not None:
                    same = page["part"] == now["part"] and page["place"] == now["place"] + 1
                    if not now["settled"]:
                        out.append((now["digest"], pair(earlier if earlier else now["earlier"], now, page if same else now["later"])))
                    earlier = now if same else None
                now = page
            if out:
                yield emit(out)
        if now is not None and not now["settled"]:
            yield emit([(now["digest"], pair(earlier if earlier else now["earlier"], now, now["later"]))])

    ordered = rows.repartition("part").sortWithinPartitions("part", "place")
    return map_batches(ordered, run, schema)


def main_text(pages: DataFrame, labels: bool = True) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Blocks are joined in page order by a line break; white space in a block is one space. A
    page without text, and a null one, has an empty text. Repeated pages have a row each. A
    page alone on its host, or beside copies alone, is differenced against nothing. Of very
    long pages the alignment takes a step of as many bits as the pair has lines for each line.

    labels: whether elements that say what they are go before differencing, or stay.
    """
    rows = pages.select("page_id", "url", "html")
    least = F.min(F.struct("path", "page_id", "host", "settled", "hashes")).alias("least")
    found = written(keys(rows, labels).groupBy("digest").agg(least).select("least.page_id", "digest", "least.host", "least.path", "least.settled", "least.hashes"))
    ranges = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    gone = written(furniture(neighbours(found, ranges)))
    if (gone.agg(F.sum(F.size("gone"))).first()[0] or 0) <= BROADCAST_LINES:
        gone = F.broadcast(gone)  # then no text is shuffled

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            kept: list[list[str]] = []
            digests: list[int] = []
            for url, page in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
                blocks, inside, has_main = lines(page, labels)
                kept.append([b for b, i in zip(blocks, inside, strict=True) if i] if has_main else blocks)
                digests.append(digest(_place(url)[0], [hashed(x) for x in blocks], has_main))
            return {"page_id": batch["page_id"], "digest": digests, "url": batch["url"], "blocks": kept}

        return fn

    parsed = arrow_map(rows, make, "page_id long, digest long, url string, blocks array<string>")
    both = parsed.join(gone, "digest", "left")
    unshared = F.filter("blocks", lambda b, i: ~F.coalesce(F.get("gone", i), F.lit(False)))
    return both.select("page_id", "url", F.array_join(unshared, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
