"""Token ids of whole texts by the tokenizers library, a word at a time.

A byte-pair tokenizer cuts a text into pieces first and merges within each.
Where a piece surely begins at a blank, the ids of the text are those of its
words one after another, so that each distinct word is encoded once and then
looked up. Texts with other white space than these rules cover are encoded
whole. The ids are always those that the library gives for the whole text.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

#: Half the distinct words, and pieces of words, that a worker remembers, at about
#: 200 bytes each; beyond it, words not seen for long are forgotten.
MEMORY = 600_000

#: White space and controls on which regular expression engines disagree.
_UNUSUAL = re.compile("[\x00-\x08\x0e-\x1f\x7f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
_BLANK_IN_WHITE = re.compile(r" (?<=\s )\s")
_DIGIT = re.compile("[0-9]")
#: What words often end in, besides letters.
_ENDS = ".,;:!?)]}*&$#%-\""
_PARTS = re.compile(r"^ [^\W\d_]+|[^\W\d_]+|[\W\d_]+")


def _byte_letters() -> str:
    """The printable letter that stands for each byte in byte-level models: the
    byte's own, or one from 256 on for bytes that don't print."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    place = {b: b for b in prints} | {b: 256 + k for k, b in enumerate(others)}
    return "".join(chr(place[b]) for b in range(256))


class Words(dict):
    """Ids of words, made when they are first asked for. Once there are `limit`,
    they become the older ones, of which those asked for again are kept on."""

    def __init__(self, limit: int, make: Callable[[str], bytes]):
        self.limit, self.make = max(1, limit), make
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids


class WordEncoder:
    """Ids of texts as little-endian unsigned numbers of `width` bytes."""

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.normalizer = self.tokenizer.normalizer
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self._code = "H" if self.width == 2 else "I"
        self.memory = memory
        self.pieces: dict[str, bytes] = {}  # parts of words, but for those that are words themselves
        self.letters = _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # no special token begins within letters, or is letters alone
        self.apart = not any(t[0].isalpha() or t[0] == " " for t in self.special if t)
        self.odd = re.compile("|".join(["'", r"\s\s", *map(re.escape, filter(None, self.special))]))
        self.kind = self._kind(path)
        self.encode = {"blank": self._by_blank, "white": self._by_white, "whole": self.whole}[self.kind]
        # words and older ones have up to 3/4 of memory each, pieces the rest of twice the memory
        self.words = Words(memory * 3 // 4, self._after_blank if self.kind == "blank" else self._lower_parts)

    @staticmethod
    def _kind(path: str) -> str:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before, norm = made.get("pre_tokenizer") or {}, made.get("normalizer")
        if made["model"].get("type") != "BPE" or sys.byteorder != "little":
            return "whole"
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and norm is None:
            return "blank"
        parts = before.get("pretokenizers") or []
        split = len(parts) == 2 and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[1].get("type") == "ByteLevel"
        kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        return "white" if split and kinds == ["NFC", "Replace", "Lowercase"] else "whole"

    def whole(self, text: str) -> bytes:
        return array(self._code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if len(self.pieces) >= self.memory // 2:
            self.pieces.clear()
        self.pieces[piece] = ids
        return ids

    def _merged(self, piece: str) -> bytes:
        """A run of letters, with a blank before it or not: one piece."""
        if piece.isascii():  # only a blank is shown by another letter
            shown = self.letters[32] + piece[1:] if piece[0] == " " else piece
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        return array(self._code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """As _merged; a piece that is all of a word is remembered as that word."""
        if self.apart and self.kind == "blank" and piece[0] == " ":
            return self.words[piece[1:]]
        if self.apart and self.kind == "white" and piece.isascii():
            return self.words[piece]
        ids = self.pieces.get(piece)
        return self._keep(piece, self._merged(piece)) if ids is None else ids

    def _parts(self, text: str) -> bytes:
        if self.odd.search(text):
            return self.whole(text)
        out = []
        for p in _PARTS.findall(text):
            if (p[1:] if p[0] == " " else p).isalpha():
                out.append(self._piece(p))
                continue
            ids = self.pieces.get(p)
            if ids is None:
                if any(c.isalnum() and not c.isdecimal() for c in p):
                    return self.whole(text)
                ids = self._keep(p, self.whole(p))
            out.append(ids)
        return b"".join(out)

    def _after_blank(self, word: str) -> bytes:
        if self.apart:
            if word.isalpha():
                return self._merged(" " + word)
            # an end that is remembered has nothing odd in it
            if (start := word.rstrip(_ENDS)).isalpha() and (end := self.pieces.get(word[len(start) :])) is not None:
                return self.words[start] + end
        return self._parts(" " + word)

    def _by_blank(self, text: str) -> bytes:
        if not text:
            return b""
        if _UNUSUAL.search(text) or _BLANK_IN_WHITE.search(text):
            return self.whole(text)
        first, *words = text.split(" ")
        return (self._parts(first) if first else b"") + b"".join(map(self.words.__getitem__, words))

    def _lower_parts(self, word: str) -> bytes:
        if word.isascii():
            if self.apart:
                low = word.lower()
                if word.isalpha():
                    return self._merged(low) if low == word else self.words[low]
                if (start := low.rstrip(_ENDS)).isalpha() and (end := self.pieces.get(low[len(start) :])) is not None:
                    return self.words[start] + end
            return self._parts(word.lower()) if not _DIGIT.search(word) else self.whole(word)
        if self.odd.search(word):
            return self.whole(word)
        plain = self.normalizer.normalize_str(word)
        parts = _PARTS.findall(plain)
        if all(p.isalpha() or p.isascii() for p in parts) and not re.search(r"\d", plain):
            return self._parts(plain)
        return self.whole(word)

    def _by_white(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, "<u2" if self.width == 2 else "<u4")


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, memory: int = MEMORY) -> WordEncoder:
    """The worker's encoder for a vocabulary file; its memory lasts from task to task."""
    if (path, memory) not in _encoders:
        _encoders.clear()
        _encoders[path, memory] = WordEncoder(path, memory)
    return _encoders[path, memory]


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)
