"""Titles that are the same up to small changes: sequence ratio or a common beginning, between two tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import kept
from ..functions import evidence as E

#: The longer of two texts of the ratio is at most this times as long as the shorter.
LONGER = (2 - E.RATIO) / E.RATIO
#: Counters of characters and of pairs of characters in a profile, and a coarser form of the second.
LETTERS, BIGRAMS, COARSE = 32, 256, 64
#: Texts that one side of a task compares at most, rows at a time, and pairs at a time.
CELL, ROWS, PAIRS = 16_384, 128, 8_192
#: From this length on difflib starts no match at characters that are over a hundredth of the second text.
AUTOJUNK = 200
PROFILE = "key long, n int, band int, runs int, profile binary"


def _profile(text: str) -> tuple[int, bytes]:
    """The most stretches that a match of difflib against ``text`` (as the second) consists of, and its counts.

    Each stretch begins at the start of both texts or holds a character that difflib has not set aside as frequent."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    n, runs = len(codes), 1 << 30
    if n >= AUTOJUNK:
        counts = np.unique(codes, return_counts=True)[1]
        runs = int(counts[counts <= n // 100 + 1].sum()) + 1
    pairs = (codes[:-1] * 2654435761 + codes[1:] * 40503) >> 7
    counts = np.concatenate([np.bincount(codes % LETTERS, minlength=LETTERS), np.bincount(pairs % BIGRAMS, minlength=BIGRAMS)])
    return runs, counts.astype(np.uint32 if n > 65_535 else np.uint16).tobytes()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("band", pa.int32()), ("runs", pa.int32()), ("profile", pa.binary())])
    step = math.log(LONGER * (1 + 1e-6))
    for batch in batches:
        texts = [E.plain_title(t) for t in batch.column("norm").to_pylist()]
        found = [(k, len(t), int(math.log(len(t)) / step), *_profile(t)) for k, t in zip(batch.column("key").to_pylist(), texts) if t]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)] if found else [pa.array([], f.type) for f in schema], schema=schema)


def _side(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Keys, lengths, most stretches, and the counts of letters, coarse and fine pairs of characters."""
    n, out = t.column("n").to_numpy(), np.empty((len(t), LETTERS + BIGRAMS), np.uint32)
    for i, x in enumerate(t.column("profile").to_pylist()):
        out[i] = np.frombuffer(x, np.uint32 if n[i] > 65_535 else np.uint16)
    # No sum of minima is over the shorter text's length, so as many bits are enough.
    out = out if n.max(initial=0) > 65_535 else out.astype(np.uint16)
    fine = out[:, LETTERS:]
    coarse = fine.reshape(len(fine), -1, COARSE).sum(1, dtype=out.dtype)
    return t.column("key").to_numpy(), n.astype(np.int64), t.column("runs").to_numpy().astype(np.int64), out[:, :LETTERS], coarse, fine


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row of a and of b (one counter a row there) the sum of the smaller counts."""
    out = np.zeros((len(a), b.shape[1]), a.dtype)
    least = np.empty_like(out)
    for i in range(a.shape[1]):
        np.minimum(a[:, i, None], b[i][None, :], out=least)
        out += least
    return out


def _close(t: pa.Table) -> pa.Table:
    """a, b: pairs of a task whose counts allow the ratio, each once."""
    left = t.column("left").to_numpy(zero_copy_only=False)
    one, two = t.filter(pa.array(left)), t.filter(pa.array(~left))
    alone = not len(two) and t.column("same")[0].as_py()
    two = one if alone else two
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(one) and len(two):
        k, n, r, letters, coarse, fine = _side(one)
        k2, n2, r2, letters2, coarse2, fine2 = _side(two)
        wide = letters if letters.dtype.itemsize > letters2.dtype.itemsize else letters2
        letters, coarse, letters2, coarse2 = (np.ascontiguousarray(x, wide.dtype) for x in (letters, coarse, letters2.T, coarse2.T))
        for at in range(0, len(k), ROWS):
            rows = slice(at, at + ROWS)
            total = n[rows, None] + n2[None, :]
            need = np.ceil(total * (E.RATIO / 2) - 1e-9).astype(np.int64)
            ok = np.minimum(n[rows, None], n2[None, :]) >= need
            if alone:
                ok &= np.arange(len(k))[rows, None] < np.arange(len(k2))[None, :]
            if not ok.any():
                continue
            ok &= _shared(letters[rows], letters2) >= need
            if not ok.any():
                continue
            # Of a stretch of characters all pairs but one are in common; what has no partner divides them.
            need -= np.minimum(total - 2 * need + 1, np.maximum(r[rows, None], r2[None, :]))
            if ok.mean() > 0.01:
                ok &= _shared(coarse[rows], coarse2) >= need
            i, j = np.nonzero(ok)
            for p in range(0, len(i), PAIRS):
                a, b = i[p : p + PAIRS], j[p : p + PAIRS]
                good = np.minimum(fine[at + a], fine2[b]).sum(1, dtype=np.int64) >= need[a, b]
                found.append((k[at + a[good]], k2[b[good]]))
    a, b = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in range(2))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _near(texts: DataFrame) -> DataFrame:
    """a, b: pairs of texts whose lengths, characters and pairs of characters allow the ratio, each pair once.

    Bands of like length are divided into cells of some 16,384 texts, and a task compares two cells."""
    profiles = kept(texts.select("key", "norm").mapInArrow(_profiles, PROFILE), "title-profiles")
    cells = profiles.groupBy("band").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    cells = kept(cells.select("band", "cells", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell")), "title-cells")
    one, two = cells.alias("one"), cells.alias("two")
    meet = (F.col("two.band") == F.col("one.band") + 1) | ((F.col("two.band") == F.col("one.band")) & (F.col("two.cell") >= F.col("one.cell")))
    tasks = one.join(two, meet).select(F.xxhash64("one.band", "one.cell", "two.band", "two.cell").alias("task"), *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("one", "two") for c in ("band", "cell")])
    same = (F.col("one_band") == F.col("two_band")) & (F.col("one_cell") == F.col("two_cell"))
    sides = tasks.select("task", same.alias("same"), F.lit(True).alias("left"), F.col("one_band").alias("band"), F.col("one_cell").alias("cell"))
    sides = sides.unionByName(tasks.where(~same).select("task", F.lit(False).alias("same"), F.lit(False).alias("left"), F.col("two_band").alias("band"), F.col("two_cell").alias("cell")))
    dealt = profiles.join(F.broadcast(cells.select("band", "cells").distinct()), "band").withColumn("cell", F.pmod("key", "cells").cast("int"))
    rows = dealt.join(F.broadcast(sides), ["band", "cell"]).select("task", "same", "left", "key", "n", "runs", "profile")
    return rows.groupBy("task").applyInArrow(_close, "a long, b long")


def _beginnings(s: pd.Series) -> pd.Series:
    out = []
    for t in s:
        h, found = hashlib.blake2b(digest_size=8), []
        for i, word in enumerate(t.split(" "), 1):
            h.update(f"{word} ".encode())
            if i >= E.PREFIX_WORDS:
                found.append(int.from_bytes(h.copy().digest(), "little", signed=True))
        out.append(found)
    return pd.Series(out)


def beginnings(norm: Column) -> Column:
    """A hash of the first five words, of the first six, and so on to the whole text."""
    return F.pandas_udf(_beginnings, "array<long>")(norm)


def _alike(texts: DataFrame) -> DataFrame:
    """a, b: a text that is the beginning of the other, of five words at least."""
    first = F.xxhash64(F.substring_index("norm", " ", E.PREFIX_WORDS))
    starts = texts.select("key", "norm", first.alias("on"))
    shared = starts.groupBy("on").agg(F.count("*").alias("rows")).where("rows > 1")
    hashes = kept(starts.join(shared, "on").select("key", beginnings(F.col("norm")).alias("h")).where(F.size("h") > 0), "title-beginnings")
    whole = hashes.select(F.col("key").alias("a"), F.element_at("h", -1).alias("on"))
    longer = hashes.select(F.col("key").alias("b"), F.explode(F.slice("h", 1, F.size("h") - 1)).alias("on"))
    return longer.join(whole, "on").select("a", "b")


def sequence_matches(queries: DataFrame, index: DataFrame, id_: str, title: str, others: bool = False) -> DataFrame:
    """query, match: the rows of ``index`` whose title is the same as a query's: equal up to case and punctuation, one the
    beginning of the other and five words long at least, or of sequence ratio 0.92 or more (``evidence.same_title``).

    Exact, and no text is compared with one that cannot match.  A ratio r of texts of length m and n takes r (m + n) / 2
    characters in common, in stretches that are bounded in number, so counts of characters and of pairs of characters
    decide over nearly all pairs of like length, in tasks of bounded size; texts are fetched for what is left.  The
    counting is quadratic in the texts of a length, at some 30 ns a pair.  Beginnings meet on hashes of whole words.
    Equal titles are one, for which its least id stands; with ``others`` a row is not its own match; a title without
    letters and digits matches nothing."""
    norm = F.trim(F.lower(F.regexp_replace(F.coalesce(F.col(title), F.lit("")), r"[^\p{L}\p{N}]+", " ")))
    asks, held = (d.select(F.col(id_).alias("id"), norm.alias("norm")).where("norm <> ''") for d in (queries, index))
    known = held.groupBy("norm").agg(F.min("id").alias("match"))
    both = known.join(asks.select("norm", F.lit(True).alias("asked")).distinct(), "norm", "full")
    texts = kept(both.select(F.xxhash64("norm").alias("key"), "norm", "match", F.coalesce("asked", F.lit(False)).alias("asked")), "titles")

    near = _near(texts).unionByName(_alike(texts))
    ways = F.explode(F.array(F.struct(F.col("a").alias("q"), F.col("b").alias("m")), F.struct(F.col("b").alias("q"), F.col("a").alias("m")))).alias("w")
    pairs = near.select(ways).select("w.*").distinct()
    if not others:
        pairs = pairs.unionByName(texts.where("asked AND match IS NOT NULL").select(F.col("key").alias("q"), F.col("key").alias("m")))
    a, b = texts.where("asked").select(F.col("key").alias("q"), F.col("norm").alias("qt")), texts.where("match IS NOT NULL").select(F.col("key").alias("m"), F.col("norm").alias("mt"), "match")
    same = pairs.join(a, "q").join(b, "m").where(E.titles_match(F.col("qt"), F.col("mt"))).select("q", "match")
    return asks.withColumn("q", F.xxhash64("norm")).join(same, "q").select(F.col("id").alias("query"), "match")
