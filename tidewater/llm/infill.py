"""Fill-in-middle: texts cut at two token boundaries and put together in another order.

Equal texts are grouped, and their token boundaries are found once, as an Elias-Fano list;
the group's documents then select their own seeded cuts from it. A text that more than
max(1,000, a ten-thousandth of the documents) have is split into parts of about so many
documents, each of which makes its list: at most 10,000 texts are so frequent, and these are
broadcast. Nothing is dropped, and texts are shuffled once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import boundaries
from tidewater.llm.common import small_batches, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Texts of more copies than the greater of these are split: copies, and a share of all rows.
COPIES, SHARE = 1_000, 10_000


@dataclass(frozen=True)
class Params:
    seed: int = 42
    #: Hundredths of the documents that are cut, and of these, that have the suffix first.
    cut: int = 50
    suffix_first: int = 80


def token_ends(raw: bytes) -> np.ndarray:
    """Where the tokens of a UTF-8 text end, in code points: each is white space and the word
    after it, or the white space at the end."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    after = np.append(space[1:], True)
    ends = np.flatnonzero(~space & after)
    if space[-1]:
        ends = np.append(ends, len(b) - 1)
    return np.cumsum((b & 0xC0) != 0x80)[ends]


def _lists(texts: pa.Array) -> pa.Array:
    ends = [token_ends(t.as_buffer().to_pybytes()) for t in texts.cast(pa.binary())]
    return pa.array([{"n": len(e), "bounds": boundaries.encode(e)} for e in ends], pa.struct([("n", pa.int64()), ("bounds", pa.binary())]))


def _cuts(lists: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    """Code points before each of two token boundaries; null where either is."""

    def at(data: bytes, i: int) -> int:
        return boundaries.select(data, i - 1) if i else 0

    out = []
    for data, a, b in zip(lists, first.to_pylist(), last.to_pylist(), strict=True):
        raw = None if a is None or b is None else data.as_buffer().to_pybytes()
        out.append(None if raw is None else {"a": at(raw, a), "b": at(raw, b)})
    return pa.array(out, pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def grouped(docs: DataFrame) -> DataFrame:
    """(text, doc_ids, bounds, n): the documents of each text, its boundaries and their number.
    Groups are by the whole text; a hash only says where it is grouped."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    most = max(COPIES, -(-docs.count() // SHARE))
    often = rows.groupBy("key").agg(F.count("*").alias("copies")).filter(F.col("copies") > most)
    often = F.broadcast(often.select("key", F.ceil(F.col("copies") / most).alias("parts")))
    rows = rows.join(often, "key", "left").withColumn("part", F.pmod(F.monotonically_increasing_id(), F.coalesce("parts", F.lit(1))))
    rows = small_batches(rows).repartition("key", "part")
    # collect_list leaves nulls out, arrays of one it keeps
    one = rows.groupBy("key", "part", "text").agg(F.flatten(F.collect_list(F.array("doc_id"))).alias("doc_ids"))
    lists = F.arrow_udf(_lists, "struct<n:bigint,bounds:binary>")
    return one.withColumn("list", lists("text")).select("text", "doc_ids", "list.bounds", "list.n")


def joined(form: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The parts of a text in the order of its form."""
    by_prefix = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", by_prefix).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts that are cut hold no mark, and no mark can
    begin inside another, so the first of each is the one that was put there."""

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.regexp_replace(output, F.lit(f"(?s)^.*?{start}"), F.lit("")), end, 1)

    middle = F.regexp_replace(output, F.lit(f"(?s)^.*?{MIDDLE}"), F.lit(""))
    by_prefix = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    by_suffix = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", by_prefix).otherwise(by_suffix)


def fill_in_middle(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each document.

    n: its tokens. form: plain, as it is, also for texts that are empty or hold a mark; psm,
    prefix, suffix, middle; spm, suffix, prefix, middle. A null text counts as empty, a null
    doc_id as an empty number; rows that repeat come out as often. Other columns aren't read.
    """
    rows = grouped(docs).select("text", "bounds", "n", F.explode("doc_ids").alias("doc_id"))
    digest = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.withColumn("digest", digest)
    number = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (number[2] % 100 >= p.cut)
    form = F.when(plain, "plain").when(number[3] % 100 < p.suffix_first, "spm").otherwise("psm")
    a, b = number[0] % (F.col("n") + 1), number[1] % (F.col("n") + 1)
    first, last = F.when(F.col("form") != "plain", F.least(a, b)), F.when(F.col("form") != "plain", F.greatest(a, b))
    cuts = F.arrow_udf(_cuts, "struct<a:bigint,b:bigint>")
    rows = rows.withColumn("form", form).withColumn("cut", cuts("bounds", first, last))
    a, b = F.col("cut.a").cast("int"), F.col("cut.b").cast("int")
    length = F.length("text")
    prefix, middle, suffix = (F.substring("text", x + 1, y - x) for x, y in ((F.lit(0), a), (a, b), (b, length)))
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(joined(F.col("form"), prefix, middle, suffix))
    return rows.select("doc_id", "n", "form", F.col("cut.a").alias("prefix_chars"), (F.col("cut.b") - F.col("cut.a")).alias("middle_chars"), output.alias("output"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts are empty ones, which stay plain; an empty table gives no rows."""
    found = fill_in_middle(table(spark, sf_dir, "documents", "doc_id", "text"))
    again = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP11_SQL = r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(cast(doc_id AS varchar), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens FROM documents
), e AS (
  SELECT *, len(tokens) AS n, ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2, ('0x' || h[17:24])::bigint AS h3, ('0x' || h[25:32])::bigint AS h4 FROM d
), f AS (
  SELECT doc_id, text, tokens, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e
), g AS (
  SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:n], '') AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM g
"""
