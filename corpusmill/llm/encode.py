"""Encoding with public tokenizer files, each distinct piece of text once.

A text is cut where a space or line break follows something that isn't white space; the tokenizers' own patterns
always end a pre-token there, so the ids of a text are the ids of its pieces in turn.  A worker keeps the ids of
the pieces it has met, up to ``MEMO`` of them.  Texts with rarer kinds of white space are encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO = 600_000
_CLOSING = string.punctuation
_PIECES = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+").findall
_RARE = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]").search


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else 256 and up in turn."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


_SYMBOLS = {b: s for b, s in byte_symbols().items()}


class Pieces:
    """Numbers the pieces of texts; ``new`` has those that were not met before.

    Words after a space are held as one Arrow array, a few bytes each, and looked up there by the distinct words of a
    batch; what starts a text, or stands in a text of odd spacing, goes by a dictionary."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.count, self.new = 0, []
        self.words, self.word_numbers = pa.array([], pa.large_string()), np.zeros(0, np.int32)
        self.others: dict[str, int] = {}

    def _other(self, piece: str) -> int:
        n = self.others.get(piece)
        if n is None:
            n = self.others[piece] = self.count
            self.count += 1
            self.new.append(piece)
        return n

    def _of_words(self, distinct: pa.Array) -> np.ndarray:
        found = pc.index_in(distinct, value_set=self.words)
        fresh = found.is_null().to_numpy(zero_copy_only=False)
        place = found.fill_null(0).to_numpy().astype(np.int64)
        more = int(fresh.sum())
        if more:
            added = distinct.filter(pa.array(fresh))
            place[fresh] = len(self.words) + np.arange(more)
            self.words = pa.concat_arrays([self.words, added])
            self.word_numbers = np.concatenate([self.word_numbers, np.arange(self.count, self.count + more, dtype=np.int32)])
            self.count += more
            self.new += [w if w[:1] == "\n" else " " + w for w in added.to_pylist()]
        return self.word_numbers[place]

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and where each text's end.  Arrow cuts at spaces and before line breaks; a
        text with white space side by side or at an end goes by a pattern."""
        if not len(column):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        words = pc.split_pattern(pc.replace_substring(column.cast(pa.large_string()), "\n", " \n"), " ")
        starts = words.offsets.to_numpy()
        starts, stops = starts[:-1] - starts[0], starts[1:] - starts[0]
        coded = words.flatten().dictionary_encode()
        del words
        at, distinct = coded.indices.to_numpy(), coded.dictionary
        side = pc.equal(distinct, "")
        for test, space in ((pc.starts_with, "\t"), (pc.ends_with, "\t"), (pc.ends_with, "\n")):
            side = pc.or_(side, test(distinct, space))
        numbers = self._of_words(distinct)[at]
        numbers[starts] = list(map(self._other, distinct.take(pa.array(at[starts])).to_pylist()))
        held = np.concatenate([[0], np.cumsum(side.to_numpy(zero_copy_only=False)[at], dtype=np.int32)])
        again = np.flatnonzero(held[stops] > held[starts])
        if len(again):
            parts = np.split(numbers, stops[:-1])
            for i in again.tolist():
                parts[i] = np.array(list(map(self._other, _PIECES(column[i].as_py()))), dtype=np.int32)
            numbers, stops = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        return numbers, stops


def rare(piece: str) -> bool:
    return _RARE(piece) is not None


def tokenizer_path(name: str) -> str:
    """A path is taken as it is; a bare name is looked up among the public tokenizer files of the machine."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of many texts by a file of the tokenizers library."""

    _own: dict[str, Encoder] = {}

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = {k: v for k, v in json.load(f).items() if k in ("normalizer", "pre_tokenizer", "model")}
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        before = spec["pre_tokenizer"] or {}
        split = [x for x in before.get("pretokenizers", [before]) if x.get("type") == "ByteLevel"]
        self.folds = "Lowercase" in steps
        # The short way below knows the two kinds of byte-level files: words with their space, or case-folded without.
        self.plain = spec["model"]["type"] == "BPE" and len(split) == 1 and not split[0]["add_prefix_space"] and (self.folds and steps == ["NFC", "Replace", "Lowercase"] or not spec["normalizer"] and before["type"] == "ByteLevel")
        self.plain = self.plain and all(any(map(str.isalnum, t.content)) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.pieces, self.model = Pieces(), self.tokenizer.model
        self.line, self.tails = self.tokenizer.encode("\n", add_special_tokens=False).ids, {}
        self._reset()

    @classmethod
    def of(cls, name: str) -> Encoder:
        if name not in cls._own:
            cls._own[name] = cls(name)
        return cls._own[name]

    def _reset(self) -> None:
        self.pieces.clear()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size, self.odd = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, bool)
        self.known = 0

    def _grow(self, array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        out = np.zeros(max(n, 2 * len(array)), array.dtype)
        out[: len(array)] = array
        return out

    def _short_way(self, piece: str) -> list[int] | None:
        """Ids of a word, perhaps with one space or line break before and ASCII punctuation after it, straight from the
        library's model: the same pre-tokens, found without its slower pattern.  None for any other piece, and where the
        file's normaliser might do more than fold simple letters."""
        lead, tail = piece[:1], ""
        spaced = lead == " "
        word = piece[1:] if spaced or lead == "\n" else piece
        if not word.isalpha():
            bare = word.rstrip(_CLOSING)
            word, tail = bare, word[len(bare) :]
            if not word.isalpha():
                return None
        ascii_ = word.isascii()
        if self.folds:
            if not ascii_ and (max(word) > "\u024f" or "\u0130" in word):
                return None
            word, spaced = word.lower(), False
        if not ascii_:
            word = word.encode().decode("latin-1").translate(_SYMBOLS)
        ids = [t.id for t in self.model.tokenize("\u0120" + word if spaced else word)]
        if tail:
            if tail not in self.tails:
                self.tails[tail] = [t.id for t in self.model.tokenize(tail)]
            ids += self.tails[tail]
        return self.line + ids if lead == "\n" else ids

    def _add(self, numbers: slice, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids = self._grow(self.ids, self.used + len(ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[numbers] = sizes
        self.at[numbers] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _settle(self) -> None:
        new, self.pieces.new = self.pieces.new, []
        n = self.known + len(new)
        self.at, self.size, self.odd = (self._grow(x, n) for x in (self.at, self.size, self.odd))
        for a in range(0, len(new), 8192):
            part = new[a : a + 8192]
            found = list(map(self._short_way, part)) if self.plain else [None] * len(part)
            left = [i for i, x in enumerate(found) if x is None]
            for i, x in zip(left, self.tokenizer.encode_batch_fast([part[i] for i in left], add_special_tokens=False)):
                found[i] = x.ids
            first = self.known + a
            self.odd[[first + i for i in left]] = [rare(part[i]) for i in left]
            self._add(slice(first, first + len(part)), np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
        self.known = n

    def flat(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, each text's followed by ``end_id``, and where each text's ids end; without added
        special tokens, special strings inside a text as the library has them.  A null is an empty text."""
        if self.known > MEMO:
            self._reset()
        column = pc.fill_null(column, "")
        collects = gc.isenabled()
        gc.disable()  # a collection would walk the whole memo again and again, and there are no cycles
        try:
            n, stops = self.pieces.numbers(column)
            self._settle()
        finally:
            if collects:
                gc.enable()
        size = self.size[n]
        sums = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ends = sums[stops]
        ids = self.ids[np.repeat(self.at[n] - sums[:-1], size) + np.arange(int(sums[-1]))]
        again = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(self.odd[n], dtype=np.int32)])[stops], prepend=0))
        if not len(again):
            return np.insert(ids, ends, np.uint32(end_id)), ends + np.arange(1, len(column) + 1)
        parts = np.split(ids, ends[:-1])
        for i, x in zip(again.tolist(), self.tokenizer.encode_batch_fast([column[i].as_py() for i in again.tolist()], add_special_tokens=False)):
            parts[i] = np.array(x.ids, dtype=np.uint32)
        end = np.array([end_id], np.uint32)
        return np.concatenate([y for x in parts for y in (x, end)]), np.cumsum([len(x) + 1 for x in parts])


def in_parts(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Positions a:b of stretches of about ``limit`` bytes."""
    sums = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    cut = [0, *(np.flatnonzero(np.diff(sums)) + 1).tolist(), len(column)]
    yield from ((a, b) for a, b in zip(cut, cut[1:]) if b > a)
