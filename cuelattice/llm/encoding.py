"""Encoding whole texts with a public tokenizer, each distinct pre-token once per worker.

A byte-pair tokenizer works on pre-tokens, and its ids for a text are those of its pre-tokens in order. Texts
of plain characters (the ranges below) are cut into their pre-tokens by the tokenizer's own rule, those whose
ids are known are looked up, and the library's model encodes the others. Other texts are cut where a
pre-token surely begins, and pieces with any other character go through the whole tokenizer, as does every
text that spells an added token of the file.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Spelling of the 256 bytes in byte-level vocabularies: printable ones stand for themselves, the others for
#: the characters from 256 on.
_KEPT_BYTES = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_ALPHABET = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - _KEPT_BYTES))}

SPELT_SPACE = chr(BYTE_ALPHABET[32])

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
PUNCT = r"!-&(-/:-@\[-`{-~"  # ASCII without the apostrophe, which begins contractions
#: A piece of plain characters, with at most one space before it and single line ends inside.
PLAIN = re.compile(rf" ?[{LETTER}{PUNCT}0-9]+(?:\n[{LETTER}{PUNCT}0-9]+)*")
STARTS = re.compile(rf" ?[{LETTER}]+| ?[0-9]+| ?[{PUNCT}]+|\n| ")
ENDS = re.compile(rf"[{LETTER}]+|[0-9]|[{PUNCT}]+")
#: Texts of plain characters only, and places where white space stands beside white space.
PLAIN_TEXT = re.compile(rf"[{LETTER}{PUNCT}0-9 \n]*")
CROWDED = re.compile(r"\s\s")
SPACED = re.compile(r"\s ")
GAP = re.compile(r"(?<=\S)(?= \S)")
#: Stands before a piece that goes through the whole tokenizer; no pre-token begins with it.
WHOLE = "\0"
#: Entries that a worker keeps; the store is emptied beyond it, which only costs time.
KEPT = 500_000


class Encoder:
    """Ids of texts as little-endian bytes of ``dtype``."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.word_ends = "a</w>" in vocab
        self.spelled = [int(i).to_bytes(self.dtype.itemsize, "little") for i in range(max(vocab.values()) + 1)]
        self.find = (ENDS if self.word_ends else STARTS).findall
        self.kept: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def keys(self, text: str) -> list[str]:
        """What the text is made of: its pre-tokens, and after a mark the pieces that only the tokenizer can read."""
        if PLAIN_TEXT.fullmatch(text) and (self.word_ends or not CROWDED.search(text)):
            return self.find(text.lower() if self.word_ends else text)
        out: list[str] = []
        for piece in self.cut(text):
            if PLAIN.fullmatch(piece):
                out += self.find(piece.lower() if self.word_ends else piece)
            elif piece:
                out.append(WHOLE + piece)
        return out

    def cut(self, text: str) -> list[str]:
        """Pieces that begin where a pre-token begins."""
        if self.word_ends:
            return text.replace("\n", " ").split(" ")
        if SPACED.search(text):
            return GAP.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def pretoken_ids(self, pretoken: str) -> bytes:
        """The model's ids of one pre-token, given in the byte alphabet of the vocabulary."""
        if pretoken.isascii() and pretoken.isprintable():
            spelt = pretoken.replace(" ", SPELT_SPACE)
        else:
            spelt = pretoken.encode().decode("latin-1").translate(BYTE_ALPHABET)
        return b"".join([self.spelled[t.id] for t in self.tokenizer.model.tokenize(spelt)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        found = [None if self.added.search(t) else self.keys(t) for t in texts]
        kept = self.kept
        for key in set().union(*filter(None, found)).difference(kept):
            kept[key] = self.ids(key[1:]) if key[0] == WHOLE else self.pretoken_ids(key)
        get = kept.__getitem__
        out = [self.ids(t) if keys is None else b"".join(map(get, keys)) for t, keys in zip(texts, found, strict=True)]
        if len(kept) > KEPT:
            kept.clear()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
