"""Exact removal of repeated byte strings by suffix order and longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes covers it that also starts elsewhere: anywhere (``keep="none"``), or at an
earlier place only, so that the first copy stays (``keep="first"``; places are ordered by doc_id, text hash, offset).

1. Every window of ``length`` bytes has an anchor, the least hash among the shorter grams in it.  Equal windows have
   equal anchors, so a *stretch*, the bytes of a run of windows of one anchor (about one and a half lengths), can only
   match stretches of equal anchors.  Anchors that occur once end here.
2. Equal stretches (128-bit BLAKE2b of their bytes) are counted before and after a shuffle; the first speaks for all,
   so that a text copied a million times enters the suffix order once.
3. Different stretches of one anchor meet in a task.  It sorts their suffixes by their first ``length`` bytes (prefix
   doubling, exact on the bytes) and reads from the previous and next smaller (and larger) places in suffix order
   which windows have an earlier (or later) match of full length.
4. An anchor with more than ``CROWD`` different stretches is divided before they meet: windows with their anchor at
   nearly the same offset have a longer string in common, which becomes their anchor; runs of such windows are
   stretches again, equal ones fold again, and what still crowds is divided eight times finer, until the anchor is the
   whole window.  So no task grows with a group, and nothing depends on ``CROWD`` but the division of work.

With ``words`` a string of fewer than ``length`` bytes counts too if it has that many whole words (between ASCII
spaces, in both places; a lone symbol is none).  Each shortest such string is a stretch that only equals others (by
two 64-bit hashes of its bytes).

Null texts are empty, and nothing matches across documents.  A text too short for either rule is left whole; a very
long one is read in segments.  Documents are known by doc_id and text: two texts under one doc_id are two documents;
rows that repeat both are each a copy (``none``) or stand for one document (``first``); a null doc_id stands for its
text.  Ties between equal strings go to the earlier place.  Empty tables give no rows; columns other than doc_id, text
and n_chars are left alone, and names of the working columns are made fresh.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE_VALUE, ORDER, SECOND_VALUE, lean, mix, powers, prefix_sums, sliding_min, texts, window_hashes, word_spans
from .shared import fresh, identity, keyed, shuffle_partitions, staged

LENGTH, CROWD, TASK_BYTES = 400, 1024, 1 << 19
HOT_COPIES, FEW_HOT = 1000, 20_000
_POSITION = np.uint64((1 << 20) - 1)
_SEGMENT = 1 << 19
#: Windows of a stretch at most; a run of one anchor is longer in periodic texts only.
_LONGEST = 4096
#: Texts whose stretches are in memory at a time.
FEW = 256
#: Bytes that make a word of what stands between spaces: letters, digits and all that isn't ASCII.
_LETTER = np.array([chr(i).isalnum() or i > 127 for i in range(256)])
STRETCH = "k long, t long, anchor long, body binary, low long, span int, hits int"


def gram_size(length: int) -> int:
    return max(8, min(64, length // 5))


def digest(raw: memoryview | bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(raw, digest_size=size).digest()


def anchor_places(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor (the leftmost of equal ones) of each window, and all gram hashes."""
    gram = gram_size(length)
    g = window_hashes(b, gram)
    least = sliding_min((g & ~_POSITION) | np.arange(len(g), dtype=np.uint64), length - gram + 1)
    return (least & _POSITION).astype(np.int64), g


def stretches(b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Start, span in bytes, anchor hash, number of anchor places, and digest of each stretch of a text."""
    out, bodies = [], []
    windows = len(b) - length + 1
    for s in range(0, max(windows, 0), _SEGMENT):
        part = b[s : min(len(b), s + _SEGMENT + length - 1)]
        n = len(part) - length + 1
        place, g = anchor_places(part, length)
        value = g[place]
        low = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1])
        size = np.diff(np.append(low, n))
        if (size > _LONGEST).any():
            times = -(-size // _LONGEST)
            low = np.repeat(low, times) + _LONGEST * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        end = np.append(low[1:], n)
        moves = np.concatenate([[0], np.cumsum(place[1:] != place[:-1])])
        raw = memoryview(np.ascontiguousarray(part))
        bodies += [digest(raw[x : y + length - 1]) for x, y in zip(low.tolist(), end.tolist())]
        out.append((low + s, end - low + length - 1, value[low], moves[end - 1] - moves[low] + 1))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.view(np.uint64), z, bodies
    return *(np.concatenate(x) for x in zip(*out)), bodies


def word_windows(b: np.ndarray, words: int, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, span, and two hashes of each string of ``words`` whole words of a text that has under ``below`` bytes."""
    out, z = [], np.zeros(0, np.int64)
    low, high = word_spans(b)
    letters = np.concatenate([[0], np.cumsum(_LETTER[b], dtype=np.int32)])
    real = letters[high] > letters[low]
    low, high = low[real].astype(np.int64), high[real].astype(np.int64)
    low, high = low[: max(len(low) - words + 1, 0)], high[words - 1 :]
    short = high - low < below
    low, high = low[short], high[short]
    for s in range(0, len(b) if len(low) else 0, _SEGMENT):
        i, j = np.searchsorted(low, [s, s + _SEGMENT])
        if i == j:
            continue
        part, a, e = b[s : s + _SEGMENT + below], low[i:j] - s, high[i:j] - s
        _, inverse = powers(len(part) + 1)
        ends = (e - a).astype(np.uint64) * ORDER[59]
        h1, h2 = (mix((sums[e] - sums[a]) * inverse[a] + ends) for sums in (prefix_sums(part, v) for v in (BYTE_VALUE, SECOND_VALUE)))
        out.append((low[i:j], e - a, h1, h2))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (z, z, z.view(np.uint64), z.view(np.uint64))


def _fixed(parts: list[bytes], width: int = 16) -> pa.Array:
    raw = b"".join(parts)
    return pa.Array.from_buffers(pa.binary(width), len(raw) // width, [None, pa.py_buffer(raw)]).cast(pa.binary())


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """So that a worker holds what belongs to few texts."""
    for batch in batches:
        for i in range(0, batch.num_rows, FEW):
            yield batch.slice(i, FEW)


def _stretch_rows(length: int, words: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            counts, columns, bodies = np.zeros(len(batch), np.int64), [], []
            for i, b in enumerate(texts(batch.column("text"))):
                low, span, anchor, hits, body = stretches(b, length)
                bodies += body
                counts[i] = len(low)
                columns.append((anchor.view(np.int64), low, span, hits))
                if words:
                    low, span, h1, h2 = word_windows(b, words, length)
                    bodies.append(np.stack([h1, h2], 1).tobytes())
                    counts[i] += len(low)
                    columns.append((h1.view(np.int64), low, span, np.ones(len(low), np.int64)))
            if counts.any():
                anchor, low, span, hits = (np.concatenate(x) for x in zip(*columns))
                who = pa.array(np.repeat(np.arange(len(batch)), counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(who), batch.column("t").take(who), pa.array(anchor), _fixed(bodies), pa.array(low), pa.array(span.astype(np.int32)), pa.array(hits.astype(np.int32))],
                    [x.split()[0] for x in STRETCH.split(", ")],
                )

    return run


def prefix_ranks(b: np.ndarray, length: int) -> np.ndarray:
    """Rank of the suffix at each byte by its first ``length`` bytes (by prefix doubling); equal prefixes share a rank.

    A rank is the place in suffix order of the first of its equals; what has no equal is settled and leaves.  Only ranks
    of places with ``length`` bytes of their own text before them mean anything."""
    n = len(b)
    rank = np.zeros(n, np.int64)
    if not n:
        return rank
    size = 1
    while size * 2 <= min(8, length):
        size *= 2
    wide, key = np.concatenate([b, np.zeros(size, np.uint8)]), np.zeros(n, np.uint64)
    for j in range(size):
        key <<= np.uint64(8)
        key |= wide[j : j + n]
    open_, base = np.arange(n), np.arange(n)
    while True:
        order = np.argsort(key, kind="stable")
        key, open_ = key[order], open_[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(first, len(key)))
        rank[open_] = np.repeat(base[first], sizes)
        more = np.repeat(sizes > 1, sizes)
        open_, base = open_[more], base[more]
        if size >= length or not len(open_):
            return rank
        step = min(size, length - size)
        after = open_ + step
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key += rank[open_] * (n + 1)
        size += step


def matched_windows(ranks: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows with their rank and place in text order: has each an earlier, and has it a later full match?

    In suffix order the longest previous factor of a place is its match with the previous or next smaller place; among
    suffixes of one rank that match is full, so it is full if either of the two stands in the same run of ranks."""
    order = np.argsort(ranks, kind="stable")
    r, p = ranks[order], place[order]
    run = np.concatenate([[0], np.cumsum(r[1:] != r[:-1])]) if len(r) else np.zeros(0, np.int64)
    wide = int(p.max() - p.min()) + 2 if len(p) else 1
    p = p - (p.min() if len(p) else 0)

    def smaller_before(x: np.ndarray, group: np.ndarray) -> np.ndarray:
        low = np.minimum.accumulate(x - group * wide)  # the groups descend, so each starts its minimum anew
        out = np.zeros(len(x), bool)
        out[1:] = (low[:-1] < x[1:] - group[1:] * wide) & (group[1:] == group[:-1])
        return out

    back = run[-1] - run[::-1] if len(run) else run
    previous, following = smaller_before(p, run), smaller_before(p[::-1], back)[::-1]
    larger_p, larger_n = smaller_before(wide - p, run), smaller_before((wide - p)[::-1], back)[::-1]
    earlier, later = np.zeros(len(r), bool), np.zeros(len(r), bool)
    earlier[order], later[order] = previous | following, larger_p | larger_n
    return earlier, later


def covered_runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans [a, e) that sorted window starts cover."""
    cut = np.flatnonzero(np.diff(starts) > length) + 1
    return starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [len(starts) - 1]])] + length


FOUND = "k long, t long, a long, e long"
PIECE = "k long, t long, low long, anchor long, kinds long, single boolean, bytes binary"


def _cut(length: int):
    """The bytes of the stretches that are asked for, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            asks = batch.column("asks")
            counts = np.diff(asks.offsets.to_numpy())
            low, span, anchor, kinds, single = asks.flatten().flatten()
            raw = [memoryview(np.ascontiguousarray(b)) for b in texts(batch.column("text"))]
            who = np.repeat(np.arange(len(batch)), counts)
            bytes_ = [bytes(raw[i][x : x + n]) for i, x, n in zip(who.tolist(), low.to_pylist(), span.to_pylist())]
            take = pa.array(who)
            yield pa.RecordBatch.from_arrays([batch.column("k").take(take), batch.column("t").take(take), low, anchor, kinds, single, pa.array(bytes_, pa.binary())], [x.split()[0] for x in PIECE.split(", ")])

    return run


def _suffix_task(length: int, earlier_only: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        k, t, low, single = (table.column(c).to_numpy() for c in ("k", "t", "low", "single"))
        raw = table.column("bytes").to_pylist()
        order = np.lexsort((low, t, k))  # text order
        k, t, low = k[order], t[order], low[order]
        again = np.concatenate([[False], (k[1:] == k[:-1]) & (t[1:] == t[:-1]) & (low[1:] == low[:-1])])  # rows that repeat a document
        k, t, low, order = k[~again], t[~again], low[~again], order[~again]
        single, raw = single[order], [raw[i] for i in order.tolist()]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        ranks = prefix_ranks(np.frombuffer(b"".join(raw), dtype=np.uint8), length)
        starts, counts = np.cumsum(sizes) - sizes, sizes - length + 1
        first = np.cumsum(counts) - counts
        window = np.arange(int(counts.sum()))  # all windows, in text order of their stretches
        own = ranks[np.repeat(starts - first, counts) + window]
        order = np.argsort(own, kind="stable")
        alike = own[order[1:]] == own[order[:-1]]
        window = np.sort(order[np.concatenate([alike, [False]]) | np.concatenate([[False], alike])])  # those with company
        owner = np.searchsorted(first, window, side="right") - 1
        # Overlapping stretches of a document by true offset: its windows are each in one stretch alone.
        doc = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]) | (t[1:] != t[:-1])]))[owner]
        place = np.empty(len(owner), np.int64)
        place[np.lexsort((low[owner] + window - first[owner], doc))] = np.arange(len(owner))
        earlier, later = matched_windows(own[window], place)
        matched = (earlier if earlier_only else earlier | later) & single[owner]
        if not matched.any():
            return pa.table({c: pa.array([], pa.int64()) for c in ("k", "t", "a", "e")})
        hit, owner = window[matched], owner[matched]
        # One number line for all stretches, with gaps of more than a window between them.
        base = np.cumsum(sizes + length + 1) - sizes
        a, e = covered_runs(base[owner] + hit - first[owner], length)
        who = np.searchsorted(base, a, side="right") - 1
        return pa.table({"k": k[who], "t": t[who], "a": a - base[who] + low[who], "e": e - base[who] + low[who]})

    return run


SUB = "k long, t long, low long, anchor long, body binary, span int, single boolean, bytes binary"


def _divide(length: int, shift: int):
    """Runs of windows whose anchors stand at offsets that agree but for the last ``shift`` bits, each under what all
    windows with such offsets have in common.  The bytes of equal runs are sent once a batch, with the first of them."""
    widest = length - gram_size(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            met, who, out = set(), [], []
            k, t, low = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "t", "low"))
            raw = batch.column("bytes").to_pylist()
            for i in np.lexsort((low, t, k)).tolist():
                b, view, base = np.frombuffer(raw[i], dtype=np.uint8), memoryview(raw[i]), int(low[i])
                place, _ = anchor_places(b, length)
                part = (place - np.arange(len(place))) >> shift
                begin = np.concatenate([[0], np.flatnonzero((place[1:] != place[:-1]) | (part[1:] != part[:-1])) + 1])
                end = np.append(begin[1:], len(place))
                for x, y, p, c in zip(begin.tolist(), end.tolist(), place[begin].tolist(), part[begin].tolist()):
                    near, far = c << shift, min(((c + 1) << shift) - 1, widest)
                    common = hashlib.blake2b(view[p - near : p + length - far], digest_size=8, salt=c.to_bytes(8, "little"), person=shift.to_bytes(8, "little")).digest()
                    body = view[x : y + length - 1]
                    name = common + digest(body)
                    who.append(i)
                    out.append((base + x, int.from_bytes(common, "little", signed=True), name[8:], len(body), None if name in met else bytes(body)))
                    met.add(name)
            take = pa.array(who, pa.int64())
            low_, anchor, body, span, bytes_ = (pa.array(c, ty) for c, ty in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())))
            yield pa.RecordBatch.from_arrays([batch.column("k").take(take), batch.column("t").take(take), low_, anchor, body, span, batch.column("single").take(take), bytes_], [x.split()[0] for x in SUB.split(", ")])

    return run


def _kinds(rows: DataFrame, hits: str, name: str) -> DataFrame:
    """A row for each different stretch whose anchor has company: how many there are, the first, and the anchor's kinds."""
    same = rows.groupBy("anchor", "body").agg(F.count("*").alias("n"), F.min(F.struct("k", "t", "low")).alias("first"), F.max("span").alias("span"), F.max(F.expr(hits)).alias("hits"))
    per = same.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("alone"), F.sum(F.col("n") * F.col("hits")).alias("total")).where("total > 1")
    return staged(same.join(per, "anchor"), name)


def _match_hot(hot: dict[tuple[int, bytes], tuple[int, int, int]], earlier_only: bool):
    """Spans of the occurrences of stretches that very many places share; overlapping ones of a text as one."""
    anchors = np.unique(np.array([a for a, _ in hot], dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = np.flatnonzero(np.isin(batch.column("anchor").to_numpy(zero_copy_only=False), anchors))
            out: list[list[int]] = []
            for anchor, body, k, t, low, span in zip(*(batch.column(c).take(pa.array(likely)).to_pylist() for c in ("anchor", "body", "k", "t", "low", "span"))):
                first = hot.get((anchor, body))
                if first is None or (earlier_only and first == (k, t, low)):
                    continue
                if out and out[-1][:2] == [k, t] and out[-1][2] <= low <= out[-1][3]:
                    out[-1][3] = max(out[-1][3], low + span)
                else:
                    out.append([k, t, low, low + span])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["k", "t", "a", "e"])

    return run


def _equal(rows: DataFrame, kinds: DataFrame, earlier_only: bool) -> DataFrame:
    """Spans of the stretches that equal another one (an earlier one).

    Stretches of more than HOT_COPIES places are few; unless there are more than FEW_HOT, which is looked at first, they
    go to where the rows are, so that no task reads all places of one stretch."""
    rows, more = rows.select("k", "t", "anchor", "body", "low", "span"), kinds.where("n > 1").select("anchor", "body", "n", "first")
    hot = more.where(F.col("n") > HOT_COPIES)
    held = {(r.anchor, bytes(r.body)): tuple(r["first"]) for r in hot.limit(FEW_HOT + 1).collect()}
    parts = []
    if 0 < len(held) <= FEW_HOT:
        parts.append(rows.mapInArrow(lean(_match_hot(held, earlier_only)), FOUND))
        rows = rows.join(F.broadcast(hot.select("anchor", "body")), ["anchor", "body"], "left_anti")
        more = more.where(F.col("n") <= HOT_COPIES)
    found = rows.join(more, ["anchor", "body"])
    if earlier_only:
        found = found.where(F.col("first") != F.struct("k", "t", "low"))
    out = found.select("k", "t", F.col("low").alias("a"), (F.col("low") + F.col("span")).alias("e"))
    for p in parts:
        out = out.unionByName(p)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "none", crowd: int = CROWD, words: int = 0) -> DataFrame:
    """k, t, a, e: byte spans [a, e) to be removed, which may overlap, of the documents known by k and t (see ``keyed``)."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    source, first = keyed(docs), keep == "first"
    least = min(length, 2 * words - 1) if words else length
    rows = staged(source.where(F.octet_length("text") >= least).select("k", "t", "text").mapInArrow(lean(_stretch_rows(length, words)), STRETCH), "spans-stretches")
    kinds = _kinds(rows, "hits", "spans-kinds")
    found = _equal(rows, kinds, first)
    # Only a stretch that nothing equals (or the first of equal ones, if it is kept) has to ask; the others are evidence.
    single = F.lit(True) if first else F.col("n") == 1
    asks = kinds.where((F.col("span") >= length) & (((F.col("kinds") > 1) & (F.lit(first) | (F.col("alone") > 0))) | ((F.col("hits") > 1) & single)))
    asks = asks.groupBy(F.col("first.k").alias("k"), F.col("first.t").alias("t")).agg(F.collect_list(F.struct(F.col("first.low").alias("low"), "span", "anchor", "kinds", single.alias("single"))).alias("asks"))
    pieces = staged(source.select("k", "t", "text").join(asks, ["k", "t"]).mapInArrow(lean(_cut(length)), PIECE), "spans-pieces")
    shift = (length - gram_size(length)).bit_length()
    while True:
        crowded = F.col("kinds") > (crowd if shift else 1 << 62)
        size = pieces.agg(F.sum(F.when(~crowded, F.octet_length("bytes"))).alias("bytes"), F.count_if(crowded).alias("crowded")).first()
        if size.bytes:
            tasks = max(shuffle_partitions(docs.sparkSession), -(-int(size.bytes) // TASK_BYTES))
            task = F.pmod(F.xxhash64("anchor"), F.lit(tasks)).alias("task")
            found = found.unionByName(pieces.where(~crowded).select(task, "k", "t", "low", "single", "bytes").groupBy("task").applyInArrow(_suffix_task(length, first), FOUND))
        if not size.crowded:
            return found
        shift = max(0, shift - 3)
        rows = staged(pieces.where(crowded).select("k", "t", "low", "single", "bytes").mapInArrow(lean(_divide(length, shift)), SUB), "spans-divided")
        kinds = _kinds(rows, "1", "spans-kinds")
        found = found.unionByName(_equal(rows, kinds, first))
        lead = rows.join(kinds.where("kinds > 1").select("anchor", "body", "n", "first", "kinds"), ["anchor", "body"]).where(F.col("first") == F.struct("k", "t", "low"))
        alone = F.col("single") if first else F.col("single") & (F.col("n") == 1)
        pieces = staged(lead.select("k", "t", "low", "anchor", "kinds", alone.alias("single"), "bytes"), "spans-pieces")


def _merged(spans: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """Overlapping and touching spans of each row as one, ascending."""
    low, high = (x.to_numpy() for x in spans.flatten().flatten())
    counts = spans.value_lengths().fill_null(0).to_numpy()
    start = 0
    for n in counts.tolist():
        if not n:
            yield []
            continue
        order = np.argsort(low[start : start + n], kind="stable")
        a, e = low[start : start + n][order], np.maximum.accumulate(high[start : start + n][order])
        cut = np.flatnonzero(a[1:] > e[:-1]) + 1
        yield list(zip(a[np.concatenate([[0], cut])].tolist(), e[np.concatenate([cut - 1, [n - 1]])].tolist()))
        start += n


def _by_document(found: DataFrame) -> DataFrame:
    """A list for each document: never more spans than its text has stretches and windows."""
    return found.groupBy("k", "t").agg(F.collect_list(F.struct("a", "e")).alias("spans"))


def removal_digest(docs: DataFrame, length: int = LENGTH, keep: str = "none", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    joined = keyed(docs).join(_by_document(repeated_spans(docs, length, keep, crowd)), ["k", "t"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            out = []
            for b, spans in zip(texts(batch.column("text")), _merged(batch.column("spans"))):
                raw, sha, at = memoryview(np.ascontiguousarray(b)), hashlib.sha256(), 0
                for a, e in spans:
                    sha.update(raw[at:a])
                    at = e
                sha.update(raw[at:])
                out.append((len(b), sum(e - a for a, e in spans), len(spans), sha.hexdigest()))
            cols = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()])]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_spans(text: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without their spans, cut at character boundaries inside them."""
    out = []
    for b, own in zip(texts(text), _merged(spans)):
        kept, at = [], 0
        for a, e in own:
            while a < e and b[a] & 0xC0 == 0x80:  # a character that the span only ends stays whole
                a += 1
            while e > a and e < len(b) and b[e] & 0xC0 == 0x80:
                e -= 1
            kept.append(b[at:a].tobytes())
            at = max(at, e)
        kept.append(b[at:].tobytes())
        out.append(b"".join(kept).decode())
    return pa.array(out, pa.string())


def without_repeats(docs: DataFrame, length: int = LENGTH, keep: str = "first", crowd: int = CROWD, words: int = 0) -> DataFrame:
    """``docs`` with repeated spans cut out of text (at character boundaries inside them), n_chars kept in step."""
    names = {c: fresh(f"spans_{c}", docs.columns) for c in ("k", "t", "list", "text")}
    found = _by_document(repeated_spans(docs, length, keep, crowd, words)).toDF(names["k"], names["t"], names["list"])
    k, t = identity(F.col("doc_id"), F.col("text"))
    own = docs.withColumn(names["k"], k).withColumn(names["t"], t).join(found, [names["k"], names["t"]], "left")

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        return without_spans(text, spans)

    # Where nothing was found the text passes as it is, a null one too.
    own = own.withColumn(names["text"], F.when(F.col(names["list"]).isNotNull(), cut("text", names["list"])))
    new = {"text": F.coalesce(names["text"], "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(names["text"]).isNotNull(), F.length(names["text"]).cast("long")).otherwise(F.col("n_chars"))
    return own.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
