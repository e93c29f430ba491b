"""Periodic runs of words, found by a suffix tree, and texts without their repeats.

A run is a stretch of consecutive words whose smallest period is q (words q apart are the same), of at least ``exponent``
periods and ``least`` words, that neither neighbour extends.  Per text:

1. Every three words of a run stand in it at least ``exponent - 1`` times (``evidence`` gives the exact bound), so runs lie
   in the stretches whose word triples are that frequent in the text.  Equal triples have equal hashes: a stretch may be
   found for nothing, none is lost.  Few ordinary texts have any.
2. The words of these stretches, numbered exactly, with a symbol of its own after each stretch, get a suffix tree: suffix
   order by prefix doubling, common prefixes from the ranks of all rounds, inner nodes as intervals of the order.
3. Each node of depth D tests the leaves i of all its children but the largest: is i + D (i - D) a leaf of the node too,
   and do the words after the two differ?  Then i (i - D) starts a branching tandem repeat of two times D words.  A leaf is
   tested only where its list is not the largest, so all tests together are n log n.
4. A run has one branching repeat, at its end.  It is rotated to the left as long as words D apart agree; rotations of one
   run merge into it; a run that has a shorter period too keeps that one.

A row is a text: nothing is shuffled, no group exists, and repeated rows are answered alike.  Null and empty texts, and
texts of white space, have no words and no runs.  A very long text must fit in a worker, with some 100 bytes a word of its
stretches.  Ties between runs (same start) go by period.  An empty table gives no rows.  Columns other than the named ones
are not read, so names never clash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import lean, shingles, texts, word_hashes, word_spans
from .mixing import WORD

EXPONENT, LEAST, GRAM = 4, 6, 3
ROWS_BYTES = 8 << 20
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def evidence(exponent: int, least: int) -> int:
    """How often each GRAM words of a run stand in it, at least: a run of period q has max(least, exponent * q) words."""
    return min((max(least, exponent * q) - GRAM + 1) // q for q in range(1, least + GRAM + 1))


def stretches(h: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Word spans [a, e) that hold all runs."""
    if len(h) < least:
        return []
    often = evidence(exponent, least) if least >= GRAM else 0
    if often < 2:
        return [(0, len(h))]
    _, kind, count = np.unique(shingles(h, GRAM), return_inverse=True, return_counts=True)
    edge = np.diff(np.concatenate([[0], (count[kind] >= often).astype(np.int8), [0]]))
    a, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + GRAM - 1
    wide = e - a >= least
    return list(zip(a[wide].tolist(), e[wide].tolist()))


def suffix_order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of ``x`` in order, the place of each, and the common prefix of each with the one before it."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int32)
    rounds, width = [rank], 1
    while width < n and int(rank.max()) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:].astype(np.int64) + 1
        key = rank.astype(np.int64) * (n + 1) + after
        order = np.argsort(key)
        new = np.zeros(n, np.int32)
        new[order[1:]] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank, width = new, 2 * width
        rounds.append(rank)
    order = np.argsort(rank)
    common = np.zeros(n, np.int64)
    i, j = order[:-1].copy(), order[1:].copy()
    for step in range(len(rounds) - 2, -1, -1):  # in the last round all ranks differ
        level, at = rounds[step], np.flatnonzero(np.maximum(i, j) < n)
        at = at[level[i[at]] == level[j[at]]]
        for moved in (i, j):
            moved[at] += 1 << step
        common[1:][at] += 1 << step
    return order, rank.astype(np.int64), common


def inner_nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each place r with a common prefix: r, and first and last leaf of the node of that depth that it lies in."""
    depth, n = common.tolist(), len(common)
    low, high, open_ = [0] * n, [n - 1] * n, [0]
    for r in range(1, n):
        d = depth[r]
        while len(open_) > 1 and depth[open_[-1]] > d:
            high[open_.pop()] = r - 1
        top = open_[-1]
        low[r] = low[top] if len(open_) > 1 and depth[top] == d else top
        open_.append(r)
    last = np.array(high, dtype=np.int64)
    r = np.flatnonzero(common > 0)
    low_ = np.array(low, dtype=np.int64)
    return r, low_[r], last[r]


def smaller_halves(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves (places in suffix order) of all children but the largest of every inner node, with the node's depth and its
    first and last leaf."""
    r, low, high = inner_nodes(common)
    if not len(r):
        return (np.zeros(0, np.int64),) * 4
    order = np.lexsort((r, common[r], low))
    r, low, high = r[order], low[order], high[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (common[r][1:] != common[r][:-1])])
    first = np.flatnonzero(new)
    # A node's children end before each of its places and at its last leaf.
    head = np.concatenate([low[first], r])
    node = np.concatenate([np.arange(len(first)), np.cumsum(new) - 1])
    order = np.lexsort((head, node))
    head, node = head[order], node[order]
    tail = np.empty(len(head), np.int64)
    tail[:-1] = head[1:] - 1
    ends = np.concatenate([np.flatnonzero(np.diff(node)), [len(node) - 1]])
    closing = np.maximum.reduceat(high, first)
    tail[ends] = closing
    size, starts = tail - head + 1, np.concatenate([[0], ends[:-1] + 1])
    largest = np.maximum.reduceat(size, starts)
    is_largest = size == largest[node]
    # One largest child alone stays out.
    seen = np.cumsum(is_largest) - np.concatenate([[0], np.cumsum(is_largest)[ends[:-1]]])[node]
    small = np.flatnonzero(~(is_largest & (seen == 1)))
    count = size[small]
    leaf = np.repeat(head[small] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    which = np.repeat(node[small], count)
    return leaf, common[r[first]][which], low[first][which], closing[which]


def branching_repeats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start i and half length D of every tandem repeat of ``x`` whose next word differs from the word D before it."""
    n = len(x)
    order, rank, common = suffix_order(x)
    leaf, depth, low, high = smaller_halves(common)
    i = order[leaf]
    found = []
    for start, other in ((i, i + depth), (i - depth, i - depth)):
        inside = (other >= 0) & (other < n)
        place = rank[np.where(inside, other, 0)]
        inside &= (place >= low) & (place <= high)
        a, d = start[inside], depth[inside]
        past = a + 2 * d
        ends = past >= n
        ends |= x[a + d] != x[np.where(ends, 0, past)]
        found.append(a[ends] * (n + 1) + d[ends])
    both = np.unique(np.concatenate(found))
    return both // (n + 1), both % (n + 1)


def rotated_left(x: np.ndarray, start: int, period: int) -> int:
    """The first place from which words ``period`` apart agree up to ``start``."""
    width = 64
    while start > 0:
        a = max(0, start - width)
        differ = np.flatnonzero(x[a:start] != x[a + period : start + period])
        if len(differ):
            return a + int(differ[-1]) + 1
        start, width = a, 2 * width
    return 0


def maximal_runs(x: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> Found:
    """Start, length and period of every run of ``x``, by start and period."""
    a, q = branching_repeats(x)
    end = a + 2 * q
    must = end - np.maximum(least, exponent * q)  # a run starts there or before
    near = np.flatnonzero(must >= 0)
    for back in (1, 2, 3, 5, 8, 13):  # most repeats are short: their rotations end within some words
        at = np.maximum(a[near] - back, must[near])
        near = near[(at >= a[near]) | (x[at] == x[at + q[near]])]
    kept: dict[tuple[int, int], int] = {}
    ending, at = [], -1  # runs that end where the repeat does
    for k in near[np.lexsort((q[near], end[near]))].tolist():
        e, d = int(end[k]), int(q[k])
        if e != at:
            ending, at = [], e
        if any(d % p == 0 and first <= e - 2 * d for first, p in ending):
            continue  # a repeat of whole periods, merged into that run
        first = rotated_left(x, e - 2 * d, d)
        ending.append((first, d))
        if first <= must[k]:
            kept[first, e - first] = min(d, kept.get((first, e - first), d))
    out = np.array(sorted((s, p, n) for (s, n), p in kept.items()), dtype=np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 2], out[:, 1]


def runs_of(text: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[int, Found]:
    """Number of words, and the runs, of a text's bytes."""
    h = word_hashes(text, lower=False)
    spans = stretches(h, exponent, least)
    if not spans:
        return len(h), (np.zeros(0, np.int64),) * 3
    starts, ends = word_spans(text)
    number: dict[bytes, int] = {}
    parts, origin = [], []
    for k, (a, e) in enumerate(spans):
        words = (text[s:t].tobytes() for s, t in zip(starts[a:e].tolist(), ends[a:e].tolist()))
        parts.append(np.array([number.setdefault(w, len(number)) for w in words] + [-1 - k], dtype=np.int64))
        origin.append(np.append(np.arange(a, e), -1))
    s, length, period = maximal_runs(np.concatenate(parts), exponent, least)
    return len(h), (np.concatenate(origin)[s], length, period)


def repeats(n: int, found: Found) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    start, length, period = found
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (start, length and period, by start and period) and collapsed: each text's words, joined by one
    space, without those that repeat a run's first period."""
    schema = docs.select(F.col(key).alias("key"))

    def rows(keys: list[pa.Array], counts: list[int], runs: list[list[dict]], texts_: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(texts_, pa.binary()).cast(pa.string())], ["key", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, kept, since, weight = [], [], [], 0, 0
            for i, raw in enumerate(texts(batch.column("text"))):
                n, found = runs_of(raw, exponent, least)
                words = raw.tobytes().split()  # bytes split at x20 and x09 to x0D
                if len(found[0]):
                    words = itertools.compress(words, (~repeats(n, found)).tolist())
                counts.append(n)
                runs.append([{"start": a, "length": b, "period": c} for a, b, c in zip(*(x.tolist() for x in found))])
                kept.append(b" ".join(words))
                weight += len(kept[-1]) + 64 * len(runs[-1])
                if weight > ROWS_BYTES or i == len(batch) - 1:
                    yield rows([batch.column("key").slice(since, i + 1 - since)], counts, runs, kept)
                    counts, runs, kept, since, weight = [], [], [], i + 1, 0

    out = f"key {schema.schema[0].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(lean(run), out)
    return found.select(F.col("key").alias(key), "n_words", "runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; each text whose crc32 of the decimal doc_id is divisible by ten repeats itself from a word on, as
    the contract of the query says.  Null doc_ids are left as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    again = F.array_join(F.slice(F.concat(F.slice("words", 1, F.col("a")), tail), F.lit(1), F.col("n")), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def runs_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run, runs_sha256, collapsed_sha256."""
    found = collapse_runs(planted(docs))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    length: Column = -F.col("best.less")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        sha(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
