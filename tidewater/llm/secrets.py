"""Secret scans in DataFrame functions alone.

Three patterns give the base spans. Beside them, two character Markov models, one of random
strings and one of ordinary identifiers, are compared by the log-likelihood ratio of their
transitions; long tokens that look far more random than like an identifier are added. The
models are trained from labelled samples: strings of digests written in several alphabets
against words of the corpus and of programs, single and put together as identifiers are, and
dates and numbers.

A kind's matches come from one extraction and one split by the same pattern: the lengths of
the pieces and of the matches add up to the places. Sums go by blocks, so that a text of many
matches takes not much more than its length.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Kinds in their order; the last is what the models add.
KINDS = ("assign", "access", "hex", "random")
ASSIGN_CHARS = 12

#: A token that the models judge, and the least log-likelihood ratio of a secret: held-out
#: names of programs stay below it, held-out random strings are above it (see the tests).
TOKEN_CHARS, LEAST_RATIO = 20, 40.0
TOKEN = rf"[A-Za-z0-9+/_-]{{{TOKEN_CHARS},}}"
#: Hexadecimal groups that stand by themselves in a token, shorter than HEX takes: those of UUIDs,
#: builds and commits.
GROUP = r"(?<![A-Za-z0-9])(?:[0-9a-f]{4,15}|[0-9A-F]{4,15})(?![A-Za-z0-9])"
#: Random strings, and about as many documents, that the models are trained on.
TRAIN_STRINGS, TRAIN_DOCS = 5_000, 300
#: Words that names in programs are made of (fixed values); they are there whatever the corpus.
NAMES = (
    "get set is has add remove create delete update find load save read write open close start stop init config request response client server user "
    "account name value index count total size list item key id type data file path url string number date time balance currency payment order by for from "
    "to with of in on all default max min handler manager service factory builder provider context exception error test node tree map array object class "
    "method field column table row query result message event queue cache session token buffer stream reader writer parser format version property"
).split()
#: Groups that the words are dealt to, where each one is joined with those after it.
WORD_GROUPS = 32
#: Weight of the frequency of a character alone, in counts, beside its transitions.
BACKOFF = 5.0
#: Characters that the models tell apart; all others are one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
STATES = len(ALPHABET) + 1

SPAN = "struct<start:int,kind:int,end:int>"


NO_SPANS = f"array<{SPAN}>"
#: Entries of a block of running().
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(entries: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array, the merge of 0 and of those before it, by blocks."""
    total = lambda x, start: F.aggregate(x, start, merge)

    def blocks(x: Column) -> Column:
        last = ((F.size(x) - 1) / BLOCK).cast("int")  # 0 for an empty array too
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(x, b * BLOCK + 1, BLOCK))

    def whole(cut: Column, sums: Column) -> Column:
        inside = lambda x, start: F.transform(x, lambda _, i: total(F.slice(x, F.lit(1), i), start))
        return F.flatten(F.transform(cut, lambda x, b: let(total(F.slice(sums, F.lit(1), b), F.lit(0)), lambda start: inside(x, start))))

    return let(entries, lambda x: let(blocks(x), lambda cut: let(F.transform(cut, lambda y: total(y, F.lit(0))), lambda sums: whole(cut, sums))))


def spans(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches with their text (value), leftmost and non-overlapping, in code
    points from 0."""
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), F.length(m).alias("match"), m.alias("value")))

    def placed(x: Column, at: Column) -> Column:
        start = at + x["piece"]
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["match"]).alias("end"), x["value"].alias("value"))

    sums = lambda p: running(F.transform(p, lambda x: x["piece"] + x["match"]), lambda a, b: a + b)
    got = let(pairs, lambda p: F.zip_with(p, sums(p), placed))
    return F.when(text.rlike(pattern), got).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def places(spans_: Column) -> Column:
    return F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def assigned(match: Column) -> Column:
    """Whether an assignment's value is long enough."""
    return F.length(F.regexp_extract(match, ASSIGN, 1)) >= ASSIGN_CHARS


def base_spans(text: Column) -> Column:
    """Spans of the three patterns, by start and then kind.

    An assignment is matched whatever its value's length and dropped afterwards, so that a
    short value still takes up its text. The other two kinds are greedy runs, for which a
    length in the pattern comes to the same.
    """
    assign = F.filter(spans(text, ASSIGN, 0), lambda s: assigned(s["value"]))
    return F.array_sort(places(F.concat(assign, spans(text, ACCESS, 1), spans(text, HEX, 2))))


def blanked(text: Column) -> Column:
    """The text with what the three patterns match, one after another, as blanks."""

    def without(pattern: str, taken: Callable[[Column], Column]) -> Callable[[Column], Column]:
        def body(t: Column) -> Column:
            blank = lambda m: F.when(taken(m), F.repeat(F.lit(" "), F.length(m))).otherwise(m)
            found = F.concat(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), blank), F.array(F.lit("")))
            whole = F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda p, m: F.concat(p, m)), "")
            return F.when(t.rlike(pattern), whole).otherwise(t)

        return body

    always = lambda m: F.lit(True)
    for pattern, taken in ((ASSIGN, assigned), (ACCESS, always), (HEX, always)):
        text = let(text, without(pattern, taken))
    return text


def states(token: Column) -> Column:
    """The state of each character of a token: its place in the alphabet, 0 outside it."""
    return F.transform(F.split(token, ""), lambda c: F.position(c, F.lit(ALPHABET)))


def random_strings(spark: SparkSession, first: int = 0, n: int = TRAIN_STRINGS) -> DataFrame:
    """Tokens of digests: in hexadecimal, in capitals and digits, in small letters and digits,
    and twice in both."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    text = F.base64(F.unhex(digest))
    alike = F.regexp_replace(text, "[+/=]", "")
    kind = F.col("id") % 5
    token = F.when(kind == 0, digest).when(kind == 1, F.upper(alike)).when(kind == 2, F.lower(alike)).otherwise(F.regexp_replace(text, "=", ""))
    return spark.range(first, first + n).select(token.alias("token"))


def identifiers(words: DataFrame) -> DataFrame:
    """Tokens of words (w, in small letters): alone, joined with the two to five words after it
    in a group in the ways that names and paths are, and with numbers and dates.

    The words must be few: a group's lie in one row.
    """
    names = words.sparkSession.createDataFrame([(x,) for x in NAMES], "w string")
    own = words.select("w", F.pmod(F.xxhash64("w"), F.lit(WORD_GROUPS)).alias("group"))
    shared = names.select("w", F.explode(F.sequence(F.lit(0), F.lit(WORD_GROUPS - 1))).alias("group"))
    groups = own.unionByName(shared).distinct().groupBy("group").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("w", "group").alias("h"), "w"))).alias("x"))
    several = lambda x, i: F.transform(F.slice(x, i + 1, F.lit(3) + F.pmod(x[i]["h"], F.lit(4)).cast("int")), lambda e: e["w"])
    rows = groups.select(F.explode(F.transform("x", lambda e, i: F.struct(e["h"].alias("h"), several(F.col("x"), i).alias("p")))).alias("r"))
    rows = rows.select("r.p", F.pmod("r.h", F.lit(100_000)).cast("string").alias("number"), F.date_add(F.lit("1990-01-01").cast("date"), F.pmod("r.h", F.lit(15_000)).cast("int")).alias("day"))
    caps = F.transform("p", lambda w: F.initcap(w))
    camel = F.concat(F.element_at("p", 1), F.array_join(F.slice(caps, 2, 9), ""))
    joined = F.array(
        F.element_at("p", 1), F.element_at(caps, 1), camel, F.array_join(caps, ""), F.concat(F.array_join(F.slice(caps, 1, 2), ""), "number"),
        F.array_join("p", "_"), F.array_join("p", "-"), F.array_join("p", "/"), F.upper(F.array_join("p", "_")), F.concat(F.array_join("p", ""), F.lit("_"), "number"),
        F.concat_ws("/", F.element_at("p", 1), "number", F.element_at("p", -1), F.substring("number", 2, 9)),
        F.concat_ws("-", F.element_at("p", 1), F.date_format("day", "yyyy-MM-dd"), "number"), F.concat(F.date_format("day", "yyyyMMdd"), F.lit("_"), "number", F.lit("_"), F.element_at("p", 1)),
    )
    return rows.select(F.explode(joined).alias("token"))


def labelled(docs: DataFrame) -> DataFrame:
    """Training strings (random boolean, token): digests as random strings; the words of NAMES
    and of about TRAIN_DOCS documents, an evenly hashed share, as identifiers. Words in base
    spans are left out."""
    share = min(1.0, TRAIN_DOCS / max(1, docs.count()))
    picked = docs.select("text") if share == 1 else docs.select("text").filter(F.xxhash64("text") < F.lit(int(share * 2**64) - 2**63))
    words = picked.select(F.explode(F.split(blanked(F.coalesce("text", F.lit(""))), r"[^A-Za-z0-9]+")).alias("w")).filter(F.col("w").rlike("^[A-Za-z]{2,19}$"))
    words = words.select(F.lower("w").alias("w")).distinct()
    strings = random_strings(docs.sparkSession)
    return strings.select(F.lit(True).alias("random"), "token").unionByName(identifiers(words).select(F.lit(False).alias("random"), "token"))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of each transition, random over identifier, in nats.

    Only counts by transition reach the driver, at most twice STATES squared of them. Each
    state's transitions are smoothed by the frequencies of characters alone.
    """
    at = states(F.col("token"))
    n = F.size(at)
    pairs = F.zip_with(F.slice(at, 1, n - 1), F.slice(at, 2, n - 1), lambda a, b: a * STATES + b)
    rows = samples.filter(F.length("token") >= 2).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()
    counts = {True: Counter(), False: Counter()}
    for r in rows:
        counts[r["random"]][r["pair"]] = r["n"]
    likely = {}
    for kind, c in counts.items():
        alone = [sum(c[a * STATES + b] for a in range(STATES)) + 0.5 for b in range(STATES)]
        alone = [x / sum(alone) for x in alone]
        for a in range(STATES):
            total = sum(c[a * STATES + b] for b in range(STATES)) + BACKOFF
            for b in range(STATES):
                likely[kind, a, b] = (c[a * STATES + b] + BACKOFF * alone[b]) / total
    return [round(math.log(likely[True, a, b] / likely[False, a, b]), 3) for a in range(STATES) for b in range(STATES)]


def ratio(token: Column, model: list[float]) -> Column:
    """Sum of the transitions' log-likelihood ratios over a token."""
    table_ = F.from_json(F.lit(json.dumps(model)), "array<double>")
    at = states(token)
    n = F.size(at)
    pairs = F.zip_with(F.slice(at, 1, n - 1), F.slice(at, 2, n - 1), lambda a, b: F.get(table_, a * STATES + b))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def judged(token: Column, model: list[float]) -> Column:
    """The ratio of a token in which short hexadecimal groups are one digit each: they are ids
    of things, such as UUIDs and names of built files, and transitions alone can't tell
    them from the pieces of a random string."""
    return ratio(F.regexp_replace(token, GROUP, "0"), model)


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """Adds base and spans, arrays of (start, kind, end) by start and then kind, to the rows,
    in place of columns of these names.

    The models' spans are tokens of 20 characters or more, or what base spans leave of them in
    pieces of as many, with a ratio of at least LEAST_RATIO (see judged). A null text is empty and has no
    spans.
    """
    model = model or train(labelled(docs))
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("_text", text).withColumn("base", base_spans(F.col("_text")))
    more = let(blanked(F.col("_text")), lambda t: places(F.filter(spans(t, TOKEN, 3), lambda s: judged(s["value"], model) >= LEAST_RATIO)))
    return rows.withColumn("spans", F.array_sort(F.concat("base", more))).drop("_text")


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans_, one), ",")


def redacted(text: Column, spans_: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by a mark."""

    def shown(s: Column, after: Column) -> Column:
        kept = F.substring(text, after + 1, F.greatest(s["start"] - after, F.lit(0)))
        return F.when(s["start"] >= after, F.concat(kept, F.lit(mark))).otherwise("")

    def whole(ends: Column) -> Column:
        pieces = F.zip_with(spans_, running(ends, lambda a, b: F.greatest(a, b)), shown)
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans_) == 0, text).otherwise(let(F.transform(spans_, lambda s: s["end"]), whole))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; repeated rows each have one, an empty table has none."""
    rows = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return rows.select("doc_id", *base_columns(), listed(F.col("spans")).alias("spans"))


def base_columns() -> list[Column]:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return [count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256")]


def op7_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the scan: all columns but spans, to which the models add. No model
    is trained for it."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.withColumn("base", base_spans(F.coalesce("text", F.lit("")))).select("doc_id", *base_columns())


OP7_BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p(kind, place, pattern) AS (VALUES
  ('assign', 0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'), ('access', 1, 'AKIA[A-Z0-9]{14,}'), ('hex', 2, '[0-9a-f]{16,}')),
m AS (SELECT doc_id, kind, place, pattern, regexp_extract_all(t, pattern) AS found, regexp_split_to_array(t, pattern) AS pieces FROM d, p WHERE regexp_matches(t, pattern)),
e AS (SELECT doc_id, kind, place, pattern, found, list_transform(found, lambda x: length(x)) AS f, list_transform(pieces, lambda x: length(x)) AS q, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, place, cast(list_sum(q[1:i]) + coalesce(list_sum(f[1:i - 1]), 0) AS bigint) AS a, f[i] AS n, found[i] AS x, pattern FROM e),
k AS (SELECT doc_id, kind, place, a, a + n AS b FROM s WHERE kind <> 'assign' OR length(regexp_extract(x, pattern, 1)) >= 12),
g AS (SELECT doc_id, count(*) FILTER (WHERE place = 0) AS n_assign, count(*) FILTER (WHERE place = 1) AS n_access, count(*) FILTER (WHERE place = 2) AS n_hex,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, place) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
