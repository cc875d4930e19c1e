"""Encoding with a public tokenizer file, word by word.

A text is cut only where the tokenizer itself always cuts; the ids of each distinct piece
are found once by the ``tokenizers`` library and kept as little-endian uint32 bytes, so a
text is one join of bytes. The result equals encoding the text at once.

Safe cuts: byte-level BPE begins a new word at a blank that follows a non-blank (the blank
belongs to what follows); the word-end BPE drops white space, so any blank or line break.
A piece of Latin letters, digits and marks goes word by word to the library's BPE model;
any other piece goes through the whole tokenizer, so Unicode tables need not agree.
"""

from __future__ import annotations

import gc
import json
import re
import struct
import unicodedata
from functools import lru_cache

import regex
from tokenizers import Tokenizer

#: A blank after other white space; where a text has none, every blank is a cut.
_SPACED = re.compile("[" + "".join(map(chr, (
    0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000
))) + "] ")
#: A line break beside other white space; where a text has none, every line break is a cut.
_SPACED_BREAK = re.compile(r"\n(?:\s|(?<=\s\n))")
#: Stands before a line break that is a cut; texts that have it are left to the library.
_BREAK = "\x1a"
_CUT = re.compile(r"(?<=\S) ")
_LATIN = re.compile(r"[!-~À-ÖØ-öø-İĲ-ž ]+")
_BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_END = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Entries of one generation in a worker (about 150 bytes each); two are kept.
_KEPT = 500_000
_MARKS = frozenset(".,;:!?")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Known(dict):
    """At most ``2 * limit`` entries: piece -> ids. A full generation steps back; what is used again moves to the new one."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.old, self.limit = make, {}, limit

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[piece] = value
        return value


class TextEncoder:
    """``encode(text)`` gives a text's ids as little-endian uint32 bytes, those of the library's
    ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        self.word_end = stored["model"].get("end_of_word_suffix") == "</w>"
        # The library cuts texts at added tokens such as <|endoftext|> before anything else;
        # a text with one is left to it whole.
        self.added = [t["content"] for t in stored.get("added_tokens", [])]
        self._added = re.compile("|".join(map(re.escape, self.added)) or "(?!)", re.IGNORECASE)
        self._starts = sorted({c for t in self.added for c in (t[:2].lower(), t[:2].upper())})
        # The word-end vocabulary is not case-sensitive, so fewer words do.
        limit = _KEPT // 2 if self.word_end else _KEPT
        self.words = _Known(self._word, limit)
        self.plain = _Known(self._piece, limit)
        self.after_blank = _Known(self._blank_piece, limit)
        self._letters = _byte_letters()
        self._latin = {
            c: "".join(self._letters[b] for b in chr(c).encode()) for c in range(0x80, 0x180) if _LATIN.fullmatch(chr(c))
        }
        self._tokenize = self.tokenizer.model.tokenize
        self._packed = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]

    def _pack(self, tokens) -> bytes:
        packed = self._packed
        return b"".join([packed[t.id] for t in tokens])

    def _word(self, word: str) -> bytes:
        if word.isascii() and word[-1] not in " \n":
            return self._pack(self._tokenize("Ġ" + word[1:] if word[0] == " " else word))
        return self._pack(self._tokenize(word.encode().decode("latin-1").translate(self._letters)))

    def _blank_piece(self, piece: str) -> bytes:
        """Ids of a piece behind a blank."""
        if piece.isascii():
            if piece.isalpha():
                return self._pack(self._tokenize("Ġ" + piece))
            word = piece[:-1]
            if word.isalpha() and piece[-1] in _MARKS:
                ids = self.after_blank.get(word)
                return (self._pack(self._tokenize("Ġ" + word)) if ids is None else ids) + self.words[piece[-1]]
            if piece[:1] == _BREAK:
                return self.words["\n"] + self._piece(piece[2:])
        elif piece[0] == _BREAK:
            return self.words["\n"] + self._piece(piece[2:])
        elif _LATIN.fullmatch(piece):
            if piece.isalpha():
                return self._pack(self._tokenize("Ġ" + piece.translate(self._latin)))
            if piece[:-1].isalpha() and piece[-1] in _MARKS:
                return self._pack(self._tokenize("Ġ" + piece[:-1].translate(self._latin))) + self.words[piece[-1]]
        return self._piece(" " + piece)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that the tokenizer would cut off as well."""
        if not piece:
            return b""
        if self.word_end and piece.isascii():
            if piece.isalpha():
                return self._pack(self._tokenize(piece.lower()))
            if piece[:-1].isalpha() and piece[-1] in _MARKS:
                return self._pack(self._tokenize(piece[:-1].lower())) + self.words[piece[-1]]
        if not _LATIN.fullmatch(piece):
            # A line break between two non-blanks is a word of its own.
            lines = piece.split("\n")
            if not self.word_end and len(lines) > 1 and all(map(_LATIN.fullmatch, lines)) and lines[0] != " ":
                first = self.after_blank[lines[0][1:]] if piece[0] == " " else self.plain[lines[0]]
                return self.words["\n"].join([first, *map(self.plain.__getitem__, lines[1:])])
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if self.word_end:
            piece = (piece if piece.isascii() else unicodedata.normalize("NFC", piece)).lower()
        blank = piece[0] == " "
        # A word, perhaps with one mark behind it, needs no pattern.
        if piece[blank:].isalpha():
            return self._word(piece)
        if piece[-1] in _MARKS and piece[blank:-1].isalpha():
            word = self.after_blank[piece[1:-1]] if blank else self.plain[piece[:-1]]
            return word + self.words[piece[-1]]
        words = (_WORD_END if self.word_end else _BYTE_LEVEL).findall(piece)
        return b"".join(map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in self._starts) and self._added.search(text) or _BREAK in text:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if self.word_end:
            return b"".join(map(self.plain.__getitem__, text.replace("\n", " ").split(" ")))
        spaced = _SPACED.search(text)
        if not spaced and "\n" in text and not _SPACED_BREAK.search(text):
            text = text.replace("\n", f" {_BREAK}\n")
        cut = _CUT.split(text) if spaced else text.split(" ")
        first = self.plain[cut[0]] if cut[0] else b""
        # An empty cut at the end is the text's last blank.
        return first + b"".join(map(self.after_blank.__getitem__, cut[1:]))


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One encoder per file and worker process. Its entries are plain strings and bytes without cycles,
    which the collector of cycles would only walk through again and again."""
    gc.set_threshold(200_000, 20, 20)
    return TextEncoder(path)
