"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged array of symbols.  In each round every sequence finds its own lowest-rank pair
and merges all its occurrences, left to right, at once; sequences without a known pair leave with their length.
Each distinct piece of text is counted once a worker (see ``encode.Pieces``).

Nulls and empty texts count 0; repeated rows count alike, whatever their doc_id; a text of any length is whole (its
longest pre-token is held in memory).  Ties: of pairs of one rank the first occurrence merges first.  An empty table gives
no rows.  ``doc_id`` and ``text`` are the only columns read, so names never clash.  A file with another model, normaliser
or pre-tokenizer than the plain byte-level one raises.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import MEMO, Pieces, byte_symbols, in_parts, rare, tokenizer_path
from .kernels import lean

#: The pre-token pattern of byte-level BPE files: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)


def _known(spec: dict, name: str) -> None:
    """Raise unless a tokenizer file is byte-level BPE as this merger counts it."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    odd += [] if model.get("type", "BPE") == "BPE" else ["model"]
    odd += ["normalizer"] if spec.get("normalizer") else []
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        odd.append("pre_tokenizer")
    if odd:
        raise ValueError(f"{name} is not plain byte-level BPE: {', '.join(odd)}")


class Merger:
    """Counts the tokens of pre-tokens by the merge ranks of a byte-level BPE file."""

    _own: dict[str, Merger] = {}

    def __init__(self, name: str):
        import regex

        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        _known(spec, name)
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[s] for _, s in sorted(byte_symbols().items())], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.span = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.span + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        self._slots()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pretokens = regex.compile(PATTERN).findall
        self.pieces = Pieces()
        self._reset()

    @classmethod
    def of(cls, name: str) -> Merger:
        if name not in cls._own:
            cls._own[name] = cls(name)
        return cls._own[name]

    def _slots(self) -> None:
        """An open-addressing table of the pair keys: most lookups end at the first slot."""
        self.bits = 18
        self.slot_key = np.full(1 << self.bits, -1, np.int64)
        self.slot = np.zeros(1 << self.bits, np.int64)
        left = np.arange(len(self.keys))
        at = self._home(self.keys)
        self.probes = 0
        while len(left):
            free = self.slot_key[at] < 0
            won, first = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.slot_key[won], self.slot[won] = self.keys[left[took]], left[took]
            keep = np.ones(len(left), bool)
            keep[took] = False
            left, at = left[keep], (at[keep] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if there is no such merge) and its place in the table."""
        at = self._home(keys)
        held = self.slot_key[at]
        hit = held == keys
        place = np.where(hit, self.slot[at], -1)
        open_ = np.flatnonzero(~hit & (held >= 0))
        at = at[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.slot_key[at]
            hit = held == keys[open_]
            place[open_[hit]] = self.slot[at[hit]]
            keep = ~hit & (held >= 0)
            open_, at = open_[keep], at[keep]
        return np.where(place >= 0, self.rank[place], NONE), place

    def count(self, pretokens: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        out = sizes.copy()
        sym = self.first[np.frombuffer(b"".join(pretokens), dtype=np.uint8)]
        alive = np.flatnonzero(sizes > 1)
        sym = sym[np.repeat(sizes > 1, sizes)]
        sizes = sizes[alive]
        while len(alive):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            key = sym[:-1] * self.span + sym[1:]
            rank, place = self._find(key)
            rank, place = np.append(rank, NONE), np.append(place, -1)
            rank[ends - 1] = NONE
            least = np.minimum.reduceat(rank, starts)
            hit = (rank == np.repeat(least, sizes)) & (rank < NONE)
            at = np.flatnonzero(hit)
            if len(at):
                fresh = np.ones(len(at), bool)
                fresh[1:] = np.diff(at) > 1
                run = np.maximum.accumulate(np.where(fresh, at, 0))
                at = at[(at - run) % 2 == 0]  # of overlapping pairs every other one, from the left
                sym[at] = self.made[place[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sizes = np.add.reduceat(keep.astype(np.int64), starts)
            out[alive] = sizes
            go = (least < NONE) & (sizes > 1)
            keep &= np.repeat(go, ends - starts)
            sym, alive, sizes = sym[keep], alive[go], sizes[go]
        return out

    def _reset(self) -> None:
        self.pieces.clear()
        self.size, self.odd = np.zeros(0, np.int64), np.zeros(0, bool)

    def _split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings, which are one token each."""
        if self.cut is None:
            return self.pretokens(text), 0
        parts = self.cut.split(text)
        if len(parts) == 1:
            return self.pretokens(text), 0
        return [x for part in parts[::2] for x in self.pretokens(part)], len(parts) // 2

    def _counts(self, texts: list[str]) -> np.ndarray:
        words, owner, special = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            found, special[i] = self._split(t)
            words += found
            owner += [i] * len(found)
        n = self.count([w.encode() for w in words])
        return np.bincount(np.array(owner, dtype=np.int64), weights=n, minlength=len(texts)).astype(np.int64) + special

    def totals(self, column: pa.Array) -> np.ndarray:
        if self.pieces.count > MEMO:
            self._reset()
        column = pc.fill_null(column, "")
        n, stops = self.pieces.numbers(column)
        new, self.pieces.new = self.pieces.new, []
        found = [self._counts(new[a : a + 50_000]) for a in range(0, len(new), 50_000)]
        self.size = np.concatenate([self.size, *found])
        self.odd = np.concatenate([self.odd, np.fromiter(map(rare, new), bool, len(new))])
        out, odd = (np.diff(np.concatenate([[0], np.cumsum(x[n])])[stops], prepend=0) for x in (self.size, self.odd))
        again = np.flatnonzero(odd).tolist()
        if again:
            out[again] = self._counts([column[i].as_py() for i in again])
        return out


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs``; tokenizer: a file name or path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger.of(tokenizer)
        for batch in batches:
            texts = batch.column("text")
            n = [merger.totals(texts.slice(a, b - a)) for a, b in in_parts(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64))], ["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select(F.col("doc_id").cast("long"), "text", size).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
