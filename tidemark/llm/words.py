"""Exact token ids of whole texts through a memo of their words.

A tokenizer whose pre-tokenizer never lets a piece cross white space, and whose normalizer works on each side of white
space alone (NFC, lower case), gives a text the ids of its words, one after the other.  ``WordIds`` checks that the
tokenizer is of this kind.  Arrow splits a column of texts at white space and finds its distinct words; each new word is
encoded once, and the texts' ids are gathered by array arithmetic.  Any other tokenizer encodes whole texts.  Words of printable ASCII and Latin-1 letters are split into pieces here and given to the model one piece at a
time; all others, and those that may hold a special string, go through the library.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import buffer_of

#: The normalizer and the piece pattern for which words may be encoded alone (fixed values of the vocabulary file).
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

_TAIL = b".,;:!?#$%&*()"  # signs that make one piece after letters and begin no special string


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """The ids of texts (UTF-8), by column or one by one."""

    def __init__(self, name: str, most_words: int = 150_000, most_pieces: int = 250_000):
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.by_word = self._separable(rules)
        self.special = [t["content"].encode() for t in rules.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.most_words, self.most_pieces = most_words, most_pieces
        self.memo = _Memo(self._word)
        self.pieces = _Memo(self._piece)

    @staticmethod
    def _separable(rules: dict) -> bool:
        normalizer, split = rules.get("normalizer") or {}, (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            [n["type"] for n in normalizer.get("normalizers", [])] == NORMALIZERS
            and [p["type"] for p in split] == ["Split", "ByteLevel"]
            and split[0]["pattern"] == {"Regex": PIECES}
            and split[0]["behavior"] == "Removed"
            and split[0]["invert"]
            and not split[1]["add_prefix_space"]
            and not split[1]["use_regex"]
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules.get("added_tokens", []))
        )

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        own = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(own)}I", *own)

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self.pieces[word.lower().decode()]
        stem = word.rstrip(_TAIL)
        if stem.isalpha():
            return self.pieces[stem.lower().decode()] + self.pieces[word[len(stem) :].decode()]
        text = word.decode()
        if _PLAIN.fullmatch(text) and not (b"<|" in word and any(s in word for s in self.special)):
            return b"".join([self.pieces[p] for p in _SPLIT.findall(text.lower())])
        return self._library(text)

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a binary column of UTF-8 texts: each word's number, the texts' ends among the words, and the numbered words' ids and their ends.

        Of another tokenizer, each text is one word.
        """
        if self.by_word:
            self.memo, self.pieces = self.memo.turned(self.most_words), self.pieces.turned(self.most_pieces)
            lists = pc.ascii_split_whitespace(column.cast(pa.large_string()))
            offsets = np.asarray(lists.offsets).astype(np.int64)
            coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
            number, ends = np.asarray(coded.indices), offsets[1:] - offsets[0]
            data, at = buffer_of(coded.dictionary.cast(pa.large_binary()))
            flat, at = data.tobytes(), at.tolist()
            memo = self.memo
            found = [memo[flat[b:e]] for b, e in zip(at, at[1:])]
        else:
            number, ends = np.arange(len(column)), np.arange(1, len(column) + 1)
            found = [self._library(t.decode()) for t in column.to_pylist()]
        return number, ends, np.frombuffer(b"".join(found), "<u4"), np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4

    def encoded(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a binary column, one text after the other, and where each text's ids end."""
        number, ends, ids, last = self.words(column)
        n = np.diff(last, prepend=0)[number]
        total = np.concatenate([[0], np.cumsum(n)])
        first = np.concatenate([[0], last])[number] - total[:-1]
        return ids[np.repeat(first, n) + np.arange(total[-1])], total[ends]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        flat, ends = self.encoded(pa.array(texts, pa.binary()))
        data = flat.tobytes()
        return [data[4 * b : 4 * e] for b, e in zip([0, *ends.tolist()], ends.tolist())]


class _Memo(dict):
    """A dictionary that computes what it lacks; of what it had before a turn, it keeps what comes up again."""

    def __init__(self, of):
        super().__init__()
        self.of, self.before = of, {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.of(key)
        self[key] = found
        return found

    def turned(self, most: int) -> _Memo:
        """This one, or above ``most`` entries a new one that falls back on it."""
        if len(self) <= most:
            return self
        after, self.before = _Memo(self.of), {}
        after.before = self
        return after


_KEPT: dict[str, WordIds] = {}


def word_ids(name: str) -> WordIds:
    """One memo for each tokenizer and Python worker; a reused worker keeps it from task to task."""
    if name not in _KEPT:
        _KEPT[name] = WordIds(name)
    return _KEPT[name]


def release() -> None:
    """Drop what a reused worker keeps of texts and tokenizers, for tasks that need the room and no ids."""
    _KEPT.clear()
