"""Whole-text encoding with the tokenizers library, remembered by piece of text."""

from __future__ import annotations

import gc
import os
import re
import sys
from array import array

import numpy as np

from scanloom.llm.common import remembered

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words, and words with the ASCII white space before them; tokens never cross their ends.
WORDS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
SPACED = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: Other white space: such texts are encoded as one piece.
EXOTIC = re.compile("[" + "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")
#: A piece that ends in marks after a letter: both tokenizers cut there. Not after U+0130, whose
#: lower form ends in a combining dot that belongs to the marks.
MARKS = frozenset(".,;:!?#$%&*|")
MARKED = re.compile(r"(?s)(.*[A-Za-zÀ-ÖØ-öø-įı-ɏ])([.,;:!?#$%&*|]+)")
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Pieces whose ids a worker remembers, in each of two generations, unless told otherwise.
PIECES_KEPT = 400_000
#: Words that one call of the library encodes together.
TOGETHER = 500


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes.

    spaced: tokens keep the white space before a word (else it is dropped and
    letters are lowered). A text is cut where no token can cross; a piece is
    encoded by the library when it is first met. The result is what the library gives
    for the whole text, special tokens that are spelt out in it included: they hold no
    white space, so they lie whole in one piece.
    """

    def __init__(self, path: str, spaced: bool, pieces_kept: int = PIECES_KEPT) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.pieces_kept = spaced, pieces_kept
        vocabulary = self.tokenizer.get_vocab()
        #: Ids that begin a word (spaced) or end one.
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.edge[k] = token.startswith(chr(0x120)) if spaced else token.endswith("</w>")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, spaced: bool, pieces_kept: int = PIECES_KEPT) -> Encoder:
        return remembered((path, spaced, pieces_kept), lambda: cls(path, spaced, pieces_kept))

    def cut(self, text: str) -> list[str]:
        if not self.spaced:  # other white space is dropped too; only these four marks aren't white space to the tokenizer
            return WORDS.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        return [text] if EXOTIC.search(text) else SPACED.findall(text)

    def _library(self, pieces: list[str]) -> None:
        """Encode pieces; those of plain letters many at a time, cut again where the vocabulary marks a word's edge."""
        lone = lambda p: p.isascii() and (p[:1] == " " and p[1:].isalpha() if self.spaced else p.isalpha())
        plain, rest = [], []
        for p in pieces:
            (plain if lone(p) else rest).append(p)
        rows = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        texts = [("" if self.spaced else " ").join(r) for r in rows]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(row):
                rest += row
                continue
            raw = ids.tobytes()
            cuts = [*(4 * edges).tolist(), len(raw)] if self.spaced else [0, *(4 * edges + 4).tolist()]
            self.known.update(zip(row, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[p] = array("I", e.ids).tobytes() if LITTLE else np.array(e.ids, "<u4").tobytes()

    def _plain(self, piece: str) -> str:
        """The piece whose ids are the same; special tokens (they end in ``|>``) are told apart by case."""
        return piece if self.spaced or not piece.isascii() or "|>" in piece else piece.lower()

    def learn(self, pieces: set[str], low: bool = False) -> None:
        """Make all pieces known. low: they stand for themselves already, as :meth:`lowered` leaves them."""
        if len(self.known) > self.pieces_kept:
            self.known, self.older = {}, self.known
        known, older, parts, small = self.known, self.older, {}, set()
        for p in pieces.difference(known):
            if p in older:
                known[p] = older[p]
            elif p[-1] in MARKS and (m := MARKED.fullmatch(p)):
                parts[p] = m.groups() if low else tuple(self._plain(x) for x in m.groups())
                small.update(parts[p])
            elif low or (plain := self._plain(p)) == p:
                small.add(p)
            else:
                parts[p] = (plain,)
                small.add(plain)
        new = []
        for p in small.difference(known):
            if p in older:
                known[p] = older[p]
            else:
                new.append(p)
        self._library(new)
        for p, own in parts.items():
            known[p] = b"".join([known[x] for x in own])

    @staticmethod
    def lowered(text: str) -> str:
        """A-Z lowered, which the tokenizer would do later; not where a special token may be spelt out."""
        return text if "|>" in text else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")

    def encode(self, texts: list[str]) -> list[bytes]:
        # Words are lists of strings: nothing cyclic to be collected, and looking for it takes a fifth of the time.
        on = gc.isenabled()
        gc.disable()
        try:
            cuts = [self.cut(t if self.spaced else self.lowered(t)) for t in texts]
            self.learn(set().union(*cuts), not self.spaced and not any("|>" in t for t in texts))
            get = self.known.__getitem__
            return [b"".join(map(get, c)) for c in cuts]
        finally:
            if on:
                gc.enable()
