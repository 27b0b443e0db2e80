"""Language identification by unigram models with all segmentations summed.

A language is a probability for each piece of a fixed public vocabulary. A word's probability
is the sum over all ways to write it in pieces, found by a forward pass over its letters, and
a text's is the product over its words. The piece probabilities are trained by expectation
maximisation over the same sums, forward and backward, from all words of a bounded sample of
labelled documents: executors hold the words and send expected counts by piece. Words of one
length go through the passes together, for all languages at once, and their sums are kept, as
words repeat. A run of more letters than STRETCH, as of a script without spaces, is taken in
stretches of so many, in training and in scoring alike.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import arrow_map, map_batches, record_batch, table, written
from tidewater.llm.packing import vocabulary_path

#: Labelled documents that each language learns from, about, copies counted once.
TRAIN_DOCS = 1_500
#: The most values of lang: a model is a number for each piece and language, at most 64 MB.
MOST_LANGUAGES = 256
#: Letters of a word, at most: one letter's least probability to this power is still a number.
STRETCH = 40
ROUNDS = 4
#: Count that each piece has beside what is seen, and the probability of any single letter
#: beside the pieces, which stands for letters that the vocabulary lacks.
SMOOTHING, LETTER = 0.01, 1e-7
#: Folds of a crc32 of doc_id; the first is held out.
FOLDS = 5
#: Words whose sums a worker keeps, and words that go through the passes together.
KEEP_WORDS, BLOCK_WORDS = 200_000, 20_000
#: Words times letters times languages of a block of training.
BLOCK_NUMBERS = 400_000
#: Texts whose new words are learned together.
BLOCK_TEXTS = 250
#: Entries up to which the pieces' tree is an array by node and letter.
DENSE = 1 << 23

WORD = re.compile(rf"[^\W\d_]{{1,{STRETCH}}}")
START = "▁"


def words(text: str | None) -> list[str]:
    """Runs of letters in lower case, in stretches; none if the text has no letter."""
    found = WORD.findall(text.lower()) if text else []
    return found if any(c.isalpha() for w in found for c in w) else []


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces that lower-case words can hold."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    every = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    letters = re.compile(rf"{START}?(?:[^\W\d_]+)|{START}")
    return sorted({p for p in every if letters.fullmatch(p) and p == p.lower()})


class Tree:
    """The pieces' tree, and the passes over it."""

    def __init__(self, vocabulary: list[str]):
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for p in vocabulary for c in p}))}
        edges: dict[tuple[int, int], int] = {}
        self.ends = np.full(len(vocabulary), 0, np.int64)  # the node at which each piece ends
        for k, piece in enumerate(vocabulary):
            node = 0
            for c in piece:
                node = edges.setdefault((node, self.letters[c]), len(edges) + 1)
            self.ends[k] = node
        self.nodes, self.width = len(edges) + 1, len(self.letters) + 1
        self.longest = max(map(len, vocabulary))
        keys = np.array([a * self.width + c for a, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(edges.values()), np.int32)[order]
        self.dense = None
        if self.nodes * self.width <= DENSE:
            self.dense = np.full(self.nodes * self.width, -1, np.int32)
            self.dense[self.keys] = self.to
        self.codes = np.zeros(0x110000, np.int32)
        for c, i in self.letters.items():
            self.codes[ord(c)] = i

    def child(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes below by a letter each, or -1."""
        key = nodes.astype(np.int64) * self.width + letters
        if self.dense is not None:
            return self.dense[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)

    def matrix(self, same_length: list[str]) -> np.ndarray:
        """Letters of words of one length, after the mark of a word's start."""
        m = len(same_length[0])
        codes = self.codes[np.array(same_length, f"<U{m}").view("<u4").reshape(len(same_length), m)]
        return np.concatenate([np.full((len(codes), 1), self.letters[START], np.int32), codes], axis=1)

    def steps(self, letters: np.ndarray, i: int):
        """(length, rows, nodes) of the pieces that may begin at letter i, by length."""
        rows, node = np.arange(len(letters)), np.zeros(len(letters), np.int32)
        for size in range(1, min(self.longest, letters.shape[1] - i) + 1):
            node = self.child(node, letters[rows, i + size - 1])
            alive = node >= 0
            if not alive.all():
                rows, node = rows[alive], node[alive]
            if not len(rows):
                return
            yield size, rows, node

    def forward(self, letters: np.ndarray, chance: np.ndarray, keep: bool = False):
        """Log of each word's sum over segmentations, in each language. chance is by node.

        keep: also the sums before each letter and the steps, for short words without scaling.
        """
        n, m = letters.shape
        ring = m + 1 if keep else min(m, self.longest) + 1
        sums = [np.zeros((n, chance.shape[1])) for _ in range(ring)]
        sums[0][:] = 1.0
        scale = np.zeros((n, 1))
        taken = []
        for i in range(m):
            now = sums[i % ring].copy()
            if not keep:
                sums[i % ring][:] = 0.0  # its place is that of letter i + ring from now on
                if i % 8 == 7:
                    low = np.where(now.max(axis=1, keepdims=True) < 1e-60, 1e60, 1.0)
                    for s in (now, *sums):
                        s *= low
                    scale -= np.log(low)
            sums[(i + 1) % ring] += now * LETTER
            for size, rows, node in self.steps(letters, i):
                sums[(i + size) % ring][rows] += now[rows] * chance[node]
                if keep:
                    taken.append((i, size, rows, node))
        total = np.log(np.maximum(sums[m % ring], 1e-300)) + scale
        return (total, sums, taken) if keep else total

    def expected(self, letters: np.ndarray, chance: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
        """Adds each piece's expected count, by node and language; counts is by word and language."""
        m = letters.shape[1]
        _, sums, taken = self.forward(letters, chance, keep=True)
        back = [np.zeros_like(sums[0]) for _ in range(m + 1)]
        back[m] = counts / np.maximum(sums[m], 1e-300)
        by_start: dict[int, list] = defaultdict(list)
        for i, size, rows, node in taken:
            by_start[i].append((size, rows, node))
        nodes, flows = [], []
        for i in range(m - 1, -1, -1):
            back[i] += back[i + 1] * LETTER
            for size, rows, node in by_start[i]:
                flow = chance[node] * back[i + size][rows]
                back[i][rows] += flow
                nodes.append(node)
                flows.append(flow * sums[i][rows])
        if nodes:
            node, flow = np.concatenate(nodes), np.concatenate(flows)
            for g in range(into.shape[1]):
                into[:, g] += np.bincount(node, flow[:, g], minlength=len(into))


class Model:
    """Languages with their piece probabilities."""

    def __init__(self, languages: list[str], vocabulary: list[str], chance: np.ndarray):
        self.languages, self.vocabulary, self.chance = languages, vocabulary, chance

    def scorer(self) -> Scorer:
        return Scorer(self)

    def broadcast(self, df: DataFrame):
        """To all tasks: pieces by languages, whatever the corpus."""
        return df.sparkSession.sparkContext.broadcast(self)


class Scorer:
    """Scores texts; a worker builds it once a task."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.tree = Tree(model.vocabulary)
        self.chance = np.zeros((self.tree.nodes, len(model.languages)))
        self.chance[self.tree.ends] = model.chance
        self.fresh()

    def fresh(self) -> None:
        self.number: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.languages)))

    def learn(self, new: list[str]) -> None:
        by_length: dict[int, list[str]] = defaultdict(list)
        for w in new:
            by_length[len(w)].append(w)
        need = len(self.number) + len(new)
        if need > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros((max(need, len(self.sums)), len(self.languages)))])
        for same in by_length.values():
            for i in range(0, len(same), BLOCK_WORDS):
                part = same[i : i + BLOCK_WORDS]
                a = len(self.number)
                self.sums[a : a + len(part)] = self.tree.forward(self.tree.matrix(part), self.chance)
                for w in part:
                    self.number[w] = len(self.number)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text, and its probability among the languages."""
        labels: list[str] = []
        scores: list[float] = []
        for i in range(0, len(texts), BLOCK_TEXTS):
            for into, got in zip((labels, scores), self._block(texts[i : i + BLOCK_TEXTS]), strict=True):
                into += got
        return labels, scores

    def _block(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [words(t) for t in texts]
        if len(self.number) > KEEP_WORDS:
            self.fresh()
        self.learn(list({w for ws in found for w in ws if w not in self.number}))
        labels, scores = [], []
        for ws in found:
            if not ws or not self.languages:
                labels.append("und")
                scores.append(0.0)
                continue
            total = self.sums[np.fromiter(map(self.number.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
            best = int(total.argmax())
            labels.append(self.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return labels, scores


def held_out():
    """Whether a document is in the held-out fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """(lang, text) of about TRAIN_DOCS labelled documents a language, outside the held-out
    fold: an evenly hashed share of each language, so that none is sorted, and of equal texts
    one, so that a large group of copies is no large sample."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).take(MOST_LANGUAGES + 1)
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, TRAIN_DOCS / r["n"])) for r in counts], "lang string, share double")
    even = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.select("lang", "text", even.alias("even")).join(F.broadcast(shares), "lang").filter("even < share")
    return picked.groupBy("lang", F.xxhash64("text")).agg(F.min("text").alias("text")).select("lang", "text")


def counted(docs: DataFrame) -> DataFrame:
    """(word, counts) of all words of the documents (lang, text), where counts is an array of
    (lang, n) with an entry for each language of the word."""

    def make():
        def fn(batch: pa.RecordBatch) -> dict:
            count: Counter = Counter()
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                count.update((lang, w) for w in words(text))
            return {"lang": [k for k, _ in count], "word": [w for _, w in count], "n": list(count.values())}

        return fn

    seen = arrow_map(docs, make, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return seen.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("counts"))


def expectations(seen: DataFrame, model: Model) -> DataFrame:
    """(piece, language, n): the expected count of each piece, both by their numbers."""
    held = model.broadcast(seen)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value.scorer()
        number = {k: i for i, k in enumerate(scorer.languages)}
        into = np.zeros_like(scorer.chance)
        by_length: dict[int, list[tuple[str, list]]] = defaultdict(list)

        def add(same: list[tuple[str, list]]) -> None:
            count = np.zeros((len(same), len(number)))
            for i, (_, counts) in enumerate(same):
                for c in counts:
                    count[i, number[c["lang"]]] = c["n"]
            scorer.tree.expected(scorer.tree.matrix([w for w, _ in same]), scorer.chance, count, into)
            same.clear()

        for batch in batches:
            for word, counts in zip(batch["word"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                same = by_length[len(word)]
                same.append((word, counts))
                if len(same) * len(word) * len(number) >= BLOCK_NUMBERS:
                    add(same)
        for same in by_length.values():
            if same:
                add(same)
        got = into[scorer.tree.ends]
        piece, language = np.nonzero(got)
        yield record_batch({"piece": piece, "language": language, "n": got[piece, language]}, "piece int, language int, n double")

    parts = map_batches(seen, run, "piece int, language int, n double")
    return parts.groupBy("piece", "language").agg(F.round(F.sum("n"), 9).alias("n"))


def train(docs: DataFrame, vocabulary: str | None = None) -> Model:
    """Learns a model from the labelled documents (doc_id, lang, text).

    The driver sees the letters, the languages and, in each round, a number for each piece and
    language; MOST_LANGUAGES bounds them.
    """
    seen = written(counted(sample(docs)))
    languages = sorted(r[0] for r in seen.select(F.explode("counts.lang").alias("lang")).distinct().collect())
    every = pieces(vocabulary or vocabulary_path("piece_bpe_32k.model"))
    if not languages:
        return Model([], every, np.zeros((len(every), 0)))
    letters = {r[0] for r in seen.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()} | {START}
    every = [p for p in every if letters.issuperset(p)]  # no other piece has a count
    model = Model(languages, every, np.full((len(every), len(languages)), 1 / len(every)))
    for _ in range(ROUNDS):
        got = np.full(model.chance.shape, SMOOTHING)
        for r in expectations(seen, model).toLocalIterator():
            got[r["piece"], r["language"]] += r["n"]
        model = Model(languages, every, got / got.sum(axis=0))
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every document. Null texts and texts without a letter
    are und with score 0, as is everything where no language was learned."""
    held = model.broadcast(docs)

    def make():
        scorer = held.value.scorer()

        def fn(batch: pa.RecordBatch) -> dict:
            labels, scores = scorer.texts(batch["text"].to_pylist())
            return {"doc_id": batch["doc_id"], "lang_pred": labels, "score": scores}

        return fn

    return arrow_map(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double")


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with lang_pred and lang_score beside their own columns."""
    held = model.broadcast(docs)
    own = docs.select([F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "lang_score")])
    schema = T.StructType([*own.schema, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held.value.scorer()
        for batch in batches:
            labels, scores = scorer.texts(batch["text"].to_pylist())
            more = [pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return map_batches(own, run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; repeated rows each have one, an empty table has none. A null
    doc_id isn't held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
