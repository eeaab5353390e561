"""Ids and piece counts by the tokenizers library, one library call per distinct chunk of text.

Both tokenizer files in use split texts at white space before they merge pieces, so a text's ids are the ids of its
chunks in order. A worker keeps chunk -> ids in a dictionary of bounded size, from which chunks go that aren't met again;
chunks outside plain Latin letters, digits
and ASCII signs always go to the library whole. Other kinds of .json files are encoded text by text.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np

#: Printable ASCII and Latin-1 letters: composed forms that lower-case one to one, with the same classes in every Unicode version.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*\Z")
WORD_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZÀ-ÖØ-öø-ÿ]+|[0-9]|[^a-zA-ZÀ-ÖØ-öø-ÿ0-9]+")
BYTE_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-ZÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ a-zA-ZÀ-ÖØ-öø-ÿ0-9]+| ")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


LETTERS = byte_letters()
#: Chunks that a generation of a worker's memory holds, some 200 bytes each.
KEEP = 600_000


#: Signs that end a word as a piece of their own.
TAILS = frozenset(".,;:!?")


def worded(chunk: str) -> bool:
    """Whether a chunk is ASCII letters alone: one piece, in any split pattern of these files."""
    return chunk.isascii() and chunk.isalpha()


def spelled(piece: str) -> str:
    if piece.isascii() and piece.isalnum():
        return piece
    return "".join([LETTERS[b] for b in piece.encode()])


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Remembered(dict):
    """make(key) by key. Two generations of `keep` entries each: when one is full it becomes the old one, from which keys that
    are met again come back. Keys of more than `longest` characters aren't kept."""

    def __init__(self, make, keep: int, longest: int):
        self.make, self.keep, self.longest, self.old = make, keep, longest, {}

    def __missing__(self, key: str):
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= self.longest:
            self[key] = found
        return found


class WordIds:
    """Ids of whole texts, as little-endian unsigned integers of `width` bytes.

    keep bounds what is remembered. Null or empty text: no ids.
    """

    def __init__(self, path: str, keep: int = KEEP):
        self.tok = load(path)
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 65_536 else 4
        self.kind = np.dtype(f"<u{self.width}")
        kinds = [x.get("type") for x in (j.get("normalizer") or {}).get("normalizers", [])]
        splits = [(x.get("type"), x.get("behavior"), x.get("use_regex")) for x in (j.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and splits == [("Split", "Removed", None), ("ByteLevel", None, False)] and not any(" " in x["content"] or "\n" in x["content"] for x in j["added_tokens"])
        self.special = re.compile("|".join(re.escape(x["content"]) for x in j["added_tokens"]) or r"(?!)")
        self.by_word &= not any(worded(x["content"].rstrip("".join(TAILS))) for x in j["added_tokens"])
        self.model = self.tok.model
        self.known = Remembered(self.chunk, keep, 60)

    def packed(self, ids: list[int]) -> bytes:
        return array(self.kind.char, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.kind).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk; its pieces are chunks of their own, unless it is one itself."""
        known = self.known
        if chunk[-1:] in TAILS and worded(chunk[:-1]):
            return known[chunk[:-1]] + known[chunk[-1]] if len(chunk) > 1 else self.piece(chunk)
        if worded(chunk):
            return known[low] if (low := chunk.lower()) != chunk else self.piece(chunk)
        if PLAIN.match(chunk) and not self.special.search(chunk):
            found = WORD_PIECES.findall(chunk.lower())
            return self.piece(chunk) if found == [chunk] else b"".join([known[p] for p in found])
        return self.packed(self.tok.encode(chunk, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        return self.packed([t.id for t in self.model.tokenize(spelled(piece))])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self.packed(self.tok.encode(text, add_special_tokens=False).ids)
        known = self.known
        return b"".join([known[c] for c in text.replace("\n", " ").split(" ")])


class PieceCounts:
    """Pieces of each distinct pre-token of a byte-level BPE file: counted once, remembered up to `keep`."""

    def __init__(self, path: str, keep: int = KEEP):
        self.tok = load(path)
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        pre = j.get("pre_tokenizer") or {}
        self.by_word = not j.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not any(re.search(r"\s", x["content"]) for x in j["added_tokens"])
        self.special = re.compile("|".join(re.escape(x["content"]) for x in j["added_tokens"]) or r"(?!)")
        self.by_word &= not any(worded(x["content"].rstrip("".join(TAILS))) for x in j["added_tokens"])
        self.model = self.tok.model
        self.known = Remembered(self.count, keep, 60)

    def count(self, unit: str) -> int:
        """Pieces of a unit: a stretch that white space sets apart, with the one space or line end before it. Its pre-tokens are
        units of their own, unless it is one itself."""
        known, word = self.known, unit.removeprefix(" ")
        if worded(word):
            return self.piece(unit)
        if word[-1:] in TAILS and worded(word[:-1]):
            return known[unit[:-1]] + known[unit[-1]]
        if unit[0] == "\n" and unit[1:] and not unit[1].isspace() and not self.special.search(unit):
            return known["\n"] + known[unit[1:]]
        if PLAIN.match(unit.lstrip(" ")) and unit[:2] != "  " and not self.special.search(unit):
            found = BYTE_PIECES.findall(unit)
            return self.piece(unit) if found == [unit] else sum([known[p] for p in found])
        return len(self.tok.encode(unit, add_special_tokens=False).ids)

    def piece(self, piece: str) -> int:
        return len(self.model.tokenize(spelled(piece)))
