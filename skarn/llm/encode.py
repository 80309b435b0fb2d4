"""Whole texts to token ids with the ``tokenizers`` library, each distinct piece of text encoded once per process.

Both kinds of vocabulary here split a text before any merge, and a merge never crosses such a split. So a text can be
cut where the split is certain whatever stands around it, and the library's ids of the pieces, put together, are its
ids of the text. Which cuts are certain is read from the tokenizer's own description; for a tokenizer of any other
kind the library gets whole texts.
"""

from __future__ import annotations

import json
import re

import numpy as np

from .kernel import HELD

#: Pieces remembered per process; beyond this number the memory starts anew.
REMEMBERED = 600_000
#: Python calls these white space and the library's pattern may not.
_ODD = re.compile("[\x1c-\x1f\x85]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters that no normal form joins with a neighbour, then ASCII marks: two pieces for either kind of vocabulary.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")


class _Unsure(Exception):
    pass


class _Pieces(dict):
    """Ids (as bytes) of a piece behind ``before``; a missing one is encoded when asked for."""

    def __init__(self, encode, word, before: str = ""):
        super().__init__()
        self.encode, self.word, self.before = encode, word, before
        self.marks: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(piece) > 64:
            return self.encode(self.before + piece)
        plain = _PLAIN.fullmatch(piece)
        if not plain:
            return self.keep(piece, self.encode(self.before + piece))
        letters, marks = plain.groups()
        if not marks:
            return self.keep(piece, self.word(self.before, letters))
        ids = self.get(letters)
        if ids is None:
            ids = self.keep(letters, self.word(self.before, letters))
        more = self.marks.get(marks)
        if more is None:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            more = self.marks[marks] = self.encode(marks)
        return self.keep(piece, ids + more)

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids
        return ids


class _Spaced(_Pieces):
    """Pieces between single spaces. Sure only if no end of a piece, or of a line in it, is white space itself."""

    def __init__(self, encode, word, lines: _Pieces):
        super().__init__(encode, word, " ")
        self.lines, self.newline = lines, encode("\n")

    def __missing__(self, piece: str) -> bytes:
        if "\n" not in piece:
            if not piece or piece[0].isspace() or piece[-1].isspace():
                raise _Unsure
            return super().__missing__(piece)
        parts = piece.split("\n")
        if not all(parts) or any(x[0].isspace() or x[-1].isspace() for x in parts):
            raise _Unsure
        return self[parts[0]] + b"".join(self.newline + self.lines[x] for x in parts[1:])


def _kind(described: dict) -> str:
    normal, before = described.get("normalizer"), described.get("pre_tokenizer") or {}
    if normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "spaced"
    steps = [x.get("type") for x in before.get("pretokenizers", [])]
    normals = {x.get("type") for x in (normal or {}).get("normalizers", [])}
    if steps == ["Split", "ByteLevel"] and normals <= {"NFC", "Replace", "Lowercase"}:
        split, byte = before["pretokenizers"]
        pattern = split.get("pattern", {}).get("Regex", "")
        if split.get("invert") and split.get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in pattern and " " not in pattern and not byte.get("use_regex") and not byte.get("add_prefix_space"):
            return "blank"
    return "whole"


class _Letters(dict):
    """What the library's normaliser and byte mapping make of one letter, as its model reads it."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.space = self.shown(" a")[: -len(self.shown("a"))]

    def shown(self, text: str) -> str:
        normal = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return "".join(x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))

    def __missing__(self, code: int) -> str:
        self[code] = found = self.shown(chr(code))
        return found


class Encoder:
    """``ids(text)``: what the library gives for the text, special tokens not added, as little-endian integers.

    A null text counts as empty. ``width`` is 2 bytes an id where the vocabulary allows it, else 4.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.kind = _kind(json.loads(self.tokenizer.to_str()))
        self.letters = _Letters(self.tokenizer)
        self.alone = _Pieces(self._library, self._word)
        self.spaced = _Spaced(self._library, self._word, self.alone)
        HELD.extend((self.alone, self.spaced))

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _word(self, before: str, letters: str) -> bytes:
        shown = letters.translate(self.letters)
        tokens = self.tokenizer.model.tokenize(self.letters.space + shown if before else shown)
        return np.array([x.id for x in tokens], dtype=self.dtype).tobytes()

    def raw(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind == "whole" or _ODD.search(text):
            return self._library(text)
        if self.kind == "blank":
            return b"".join(map(self.alone.__getitem__, text.split()))
        head, _, rest = text.partition(" ")
        try:
            if not head or head[0].isspace() or head[-1].isspace():
                raise _Unsure
            lines = head.split("\n")
            if not all(lines) or any(x[0].isspace() or x[-1].isspace() for x in lines):
                raise _Unsure
            first = self.spaced.newline.join(map(self.alone.__getitem__, lines))
            return first if len(head) == len(text) else first + b"".join(map(self.spaced.__getitem__, rest.split(" ")))
        except _Unsure:
            head, *rest = _CUT.split(text)
            return self._library(head) + b"".join(self._library(" " + x) for x in rest)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.raw(text), dtype=self.dtype)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def little_endian_u32(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()
