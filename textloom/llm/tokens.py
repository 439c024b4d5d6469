"""Exact, memoised encoding with public tokenizers: each distinct unit goes through the library's BPE model once.

A text is split into units at places that no pre-token spans, whatever is around them: for byte-level BPE a single space between
two characters that are no white space (it begins the next unit), for word-level BPE any white space. Ids are kept by unit; a new
unit is normalised and cut into pre-tokens as the tokenizer file says, and each pre-token goes to the model.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space in Python or in the pre-tokenisers' patterns, besides space and newline.
_RARE_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_ODD_SPACES = ("  ", " \n", "\n ")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Pre-token patterns of the two kinds of tokenizer file that are supported (fixed values of those formats).
BYTE_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_LEVEL = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Entries of a memo, and how many of them, the first that were met and so the common ones, stay when it is full.
MEMO_ENTRIES, MEMO_STAY = 600_000, 200_000


def trim(memo: dict, entries: int = MEMO_ENTRIES, stay: int = MEMO_STAY) -> None:
    """Keeps a long-lived worker's memory bounded."""
    if len(memo) > entries:
        first = dict(islice(memo.items(), stay))
        memo.clear()
        memo.update(first)


@lru_cache(maxsize=1)
def byte_characters() -> dict[int, str]:
    """Byte-level BPE's character for each byte: printable Latin-1 stays, the others follow from U+0100 on, in order."""
    stay = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = (b for b in range(256) if b not in stay)
    return {**{b: chr(b) for b in stay}, **{b: chr(256 + i) for i, b in enumerate(moved)}}


class MemoEncoder:
    """Encodes whole texts.

    Strings of special tokens in a text are ordinary text, as the description of the tokenizer files has it
    (``encode_special_tokens = True``); with ``special_ids`` they become the tokens' ids, as in a library object without that.
    """

    def __init__(self, path: str, special_ids: bool = False):
        from tokenizers import Tokenizer

        with open(path) as f:
            content = json.load(f)
        self.folded = content["normalizer"] is not None
        special = {t["content"]: t["id"] for t in content["added_tokens"] if t["special"]}
        self.special = {t: array("I", [i]).tobytes() for t, i in special.items()} if special_ids else {}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.pattern = WORD_LEVEL if self.folded else BYTE_LEVEL
        self.memo: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def units(self, text: str) -> list[str]:
        """Units without the space that begins them; the first is marked by a space of its own, as nothing precedes it."""
        if self.folded:
            return [text] if _SEPARATORS.search(text) else text.split()
        if any(s in text for s in _ODD_SPACES) or text[-1:] == " " or any(map(text.__contains__, _RARE_SPACES)):
            parts = _BETWEEN.split(text)
        else:
            parts = text.split(" ")
        parts[0] = " " + parts[0]
        return parts

    def normalise(self, unit: str) -> str:
        if not self.folded:
            return unit[1:] if unit[:1] == " " else " " + unit
        if unit.isascii():
            return unit.lower()
        if "Σ" in unit:  # the library lower-cases a final capital sigma without regard to its place
            return self.tokenizer.normalizer.normalize_str(unit)
        return unicodedata.normalize("NFC", unit).lower()

    def piece(self, piece: str) -> bytes:
        """Ids of a pre-token, from the library's model."""
        if piece.isascii() and piece.isprintable():
            spelt = piece.replace(" ", "Ġ")
        else:
            spelt = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(byte_characters())
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def unit(self, unit: str) -> bytes:
        """Ids of a unit, kept from now on."""
        text = self.normalise(unit)
        word = text if self.folded else text[1:]
        plain = self.folded or text[:1] == " " or text[:1].isalpha()  # a text may begin with a mark
        if plain and word.isalpha():  # one pre-token
            found = self.piece(text)
        elif plain and word[:-1].isalpha() and word[-1] in ".,;:!?":  # a word and a mark
            if (mark := self.marks.get(word[-1])) is None:
                mark = self.marks[word[-1]] = self.piece(word[-1])
            found = self.piece(text[:-1]) + mark
        else:
            found = b"".join(map(self.piece, self.pattern.findall(text)))
        self.memo[unit] = found
        return found

    def encode_text(self, text: str) -> np.ndarray:
        if self.special and any(map(text.__contains__, self.special)):  # the parts between them are texts by themselves
            parts = self.at_special.split(text)
            ids = [np.frombuffer(self.special[p], "<u4") if p in self.special else self._encode(p) for p in parts if p]
            return np.concatenate(ids)
        return self._encode(text)

    def _encode(self, text: str) -> np.ndarray:
        units = self.units(text)
        found = list(map(self.memo.get, units))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                found[at] = self.memo.get(units[at]) or self.unit(units[at])
        except ValueError:  # none left
            pass
        if len(self.memo) > MEMO_ENTRIES:
            trim(self.memo)
        return np.frombuffer(b"".join(found), "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return list(map(self.encode_text, texts))

    def ids_ending(self, ends: str) -> np.ndarray:
        """For each id, whether its piece ends with one of these characters (word-end marks aside)."""
        table = np.zeros(self.size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            table[i] = piece.removesuffix("</w>").endswith(tuple(ends))
        return table


@lru_cache(maxsize=4)
def encoder(path: str, special_ids: bool = False) -> MemoEncoder:
    """One encoder for each worker process, file and way."""
    return MemoEncoder(path, special_ids)
