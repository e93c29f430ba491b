"""Packing documents into sequences: first-fit decreasing over a tournament tree of bin capacities.

A document's ids (with its end id) fill whole sequences first; what is left of it, shorter than a sequence, is
packed with others.  Documents are dealt into groups at random (by a hash of the place where a document was read, so
that repeated rows spread like any others), and each group is packed on its own.  Only piece descriptions are shuffled,
never ids.

A sequence is padded to the capacity, except at a power of two: one whose ids number a power of two is whole as it is.
``padded`` says what length each piece's sequence has in the end.

Nulls count as empty texts; an empty text is its end id alone; repeated rows are packed as documents of their own;
a text of any length is cut into pieces of one sequence.  Pieces of equal length go in order of doc_id, place and
checksum.  Empty tables give no pieces.  Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import Encoder, in_parts
from .kernels import lean
from .shared import staged

GROUP = 8192


class Tournament:
    """A complete binary tree over bins; each inner node holds the larger capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for ``size``, and what room it had."""
        tree, leaves, node = self.tree, self.leaves, 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        room = tree[node]
        tree[node] = room - size
        bin_ = node - leaves
        while node > 1:
            node //= 2
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a > b else b
            if tree[node] == best:
                break
            tree[node] = best
        return bin_, room


def first_fit_decreasing(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ``sizes`` must descend, none above ``capacity``."""
    tree = Tournament(max(1, len(sizes)), capacity)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes):
        bins[i], room = tree.place(size)
        offsets[i] = capacity - room
    return bins, offsets


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
ROW = ", row long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder.of(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column("text")
            doc_ids, rows, who = batch.column("doc_id"), [], []
            for a, b in in_parts(texts):
                ids, ends = encoder.flat(texts.slice(a, b - a), end_id)
                raw, low = memoryview(ids.astype("<u4", copy=False)).cast("B"), 0
                for i, high in enumerate(ends.tolist(), a):
                    for start in range(low, high, capacity):
                        stop = min(start + capacity, high)
                        rows.append((start - low, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), high - low))
                        who.append(i)
                    low = high
            cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(who, pa.int64())), *[pa.array(cols[:, j]) for j in range(4)], pa.array(seen + np.array(who, dtype=np.int64))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])
            seen += len(batch)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), PIECE + ROW)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded of each piece."""
    pieces = staged(cut_pieces(docs, tokenizer, end_id, capacity), "pack-pieces")
    groups = max(1, -(-pieces.count() // group))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        table = table.take(order)
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        table = table.drop_columns(["pack_group", "row"])
        fill = np.bincount(bins, weights=table.column("length").to_numpy()).astype(np.int64) if len(table) else np.zeros(0, np.int64)
        padded = np.where(fill & (fill - 1), capacity, fill)
        table = table.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins))
        return table.append_column("offset", pa.array(offsets)).append_column("padded", pa.array(padded[bins]))

    # Pieces that fill a sequence need no packing; they take part in their group all the same, so ids stay unique.
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("row", "doc_id"), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInArrow(run, PIECE + ", sequence_id long, offset long, padded long")
