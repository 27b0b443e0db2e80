"""Token ids of whole texts, word by word.

Both vocabularies used here cut a text between a non-space character and a following
space or line break, so a text's ids are those of its words put together. Words repeat,
so their ids are kept. A new word that is Latin letters and then marks goes to the
vocabulary's merges at once; other new words go through the whole tokenizer. Texts with
any other or doubled white space are encoded whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Words whose ids a worker keeps; beyond it the store starts afresh.
KEEP_WORDS = 400_000

PLAIN = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: printable bytes stand
    for themselves, the others follow from U+0100 on in ascending order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Store(dict):
    """Ids by key, found on first use."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, key: str) -> bytes:
        got = self[key] = self.find(key)
        return got


class WordCodec:
    """encode() gives the ids that the tokenizers library gives for each whole text with
    add_special_tokens=False. folds: the vocabulary drops white space and case."""

    def __init__(self, vocabulary: str, folds: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.folds = folds
        self.letters = byte_letters()
        self.space = "" if folds else self.letters[0x20]
        self.merges = self.tokenizer.model.tokenize
        self.known = Store(self.word)  # words after a space, or after the break they begin with
        self.bare = Store(self.bare_word)  # words with nothing before them
        self.whole_parts = Store(self.whole)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, text: str) -> list[str] | None:
        """Words, those after a line break with the break in front; None: encode it whole."""
        out = text.replace("\n", " " if self.folds else " \n").split(" ")
        if "" in out or len(out) != len(text.split()) or any(s in text for s in self.special):
            return None
        return out

    def letters_only(self, before: str, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges(before + piece)]).tobytes()

    def word(self, w: str) -> bytes:
        if w.isascii() and w.isalpha():
            if self.folds and (low := w.lower()) != w:
                return self.known[low]
            return self.letters_only(self.space, w)
        if not (m := PLAIN.fullmatch(w)):
            return self.whole(w if self.folds or w[0] == "\n" else " " + w)
        if m[1]:
            return self.whole_parts["\n"] + self.bare[m[2]] + (self.whole_parts[m[3]] if m[3] else b"")
        if m[3]:
            return self.known[m[2]] + self.whole_parts[m[3]]
        if self.folds and (low := w.lower()) != w:
            return self.known[low]
        return self.letters_only(self.space, w)

    def bare_word(self, w: str) -> bytes:
        return self.letters_only("", w) if PLAIN.fullmatch(w) and w.isalpha() and not self.folds else self.whole(w)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null and empty texts have none."""
        out = []
        for text in texts:
            for store in (self.known, self.bare, self.whole_parts):
                if len(store) > KEEP_WORDS:
                    store.clear()
            words = self.words(text) if text else None
            if words is None:
                out.append(self.whole(text) if text else b"")
            elif self.folds:
                out.append(b"".join(map(self.known.__getitem__, words)))
            else:
                out.append(self.bare[words[0]] + b"".join(map(self.known.__getitem__, words[1:])))
        return out


_CODECS: dict[tuple[str, bool], WordCodec] = {}


def codec(vocabulary: str, folds: bool) -> WordCodec:
    """One codec for each worker process."""
    if (vocabulary, folds) not in _CODECS:
        _CODECS[vocabulary, folds] = WordCodec(vocabulary, folds)
    return _CODECS[vocabulary, folds]
