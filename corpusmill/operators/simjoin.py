"""Exact fuzzy title join: equal normalised text first, else token Jaccard by prefix filtering, best match a query."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import kept
from ..functions import stats


#: Longs of the bits that stand for a title's words, and for those of a whole text.
TITLE_LONGS, SET_LONGS = 3, 8


def set_bits(hashes: Column, part: int, parts: int) -> Column:
    """One of ``parts`` longs in which each hash of an array has set one bit.  Two sets differ in as many elements at least
    as their bits differ."""
    own = F.filter(hashes, lambda h: F.pmod(F.shiftright(h, 6), F.lit(parts)) == part)
    return F.aggregate(own, F.lit(0).cast("long"), lambda bits, h: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))))


def token_sets(rows: DataFrame, id_: str, tokens: str) -> DataFrame:
    """(id, set): each row's distinct tokens as hashes, rarest first: the order in which prefixes are shortest to probe.
    Equal document frequencies are ordered by the hash, the same for all rows."""
    flat = rows.select(id_, F.explode(F.array_distinct(tokens)).alias("t")).select(id_, F.xxhash64("t").alias("token"))
    df = flat.groupBy("token").agg(F.count("*").alias("df"))
    return flat.join(df, "token").groupBy(id_).agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"]).alias("set"))


#: Rows whose tokens are counted for the order, and tokens that the order knows as frequent.
SAMPLE, FREQUENT = 16_384, 65_536


def frequent_tokens(rows: DataFrame, id_: str) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that a sample of the sets has most often, ascending, and how often.  They only order tokens: any order
    gives the same matches, a good one fewer pairs."""
    parts = max(1, rows.count() // SAMPLE)
    flat = rows.where(F.pmod(F.xxhash64(id_), F.lit(parts)) == 0).select(F.explode("set").alias("token"))
    top = flat.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").orderBy(F.desc("df"), "token").limit(FREQUENT).toPandas().sort_values("token")
    return top["token"].to_numpy(np.int64), top["df"].to_numpy(np.int64)


def rarest_first(sets: Column, order: tuple[np.ndarray, np.ndarray]) -> Column:
    """Sets of hashes by rising frequency, then by hash; one order for all rows, without a shuffle."""
    tokens, df = (np.append(x, last) for x, last in zip(order, (np.iinfo(np.int64).max, 0)))

    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            x = np.asarray(x, np.int64)
            at = np.searchsorted(tokens, x)
            out.append(x[np.lexsort((x, np.where(tokens[at] == x, df[at], 0)))])
        return pd.Series(out)

    return F.pandas_udf(run, "array<long>")(sets)


def parities(x: np.ndarray) -> np.ndarray:
    """A few longs of bits: whether an odd number of a set's hashes falls on each.  Of sets that have little in common half
    of the bits differ, however large the sets; bits that are only set would fill up."""
    odd = np.bincount(np.asarray(x, np.int64) & (64 * SET_LONGS - 1), minlength=64 * SET_LONGS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bits(x: np.ndarray) -> bytes:
    """A bit for each hash of a set, of as many bits as the next power of two at or above its size, 64 at least."""
    out = np.zeros(max(64, 1 << max(0, len(x) - 1).bit_length()), np.uint8)
    out[np.asarray(x, np.int64) & (len(out) - 1)] = 1
    return np.packbits(out).tobytes()


def marked(rows: DataFrame) -> DataFrame:
    """rows with marks, the parities of each set, and sketch, its bits.  Two sets differ in as many elements at least as
    either of them."""
    marks = F.pandas_udf(lambda s: pd.Series([parities(x) for x in s], dtype=object), "array<long>")
    sketch = F.pandas_udf(lambda s: pd.Series([bits(x) for x in s], dtype=object), "binary")
    return rows.select("*", marks("set").alias("marks"), sketch("set").alias("sketch"))


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the larger one folded to the size of the other: at most as many as elements in
    which the two sets differ, whatever their size."""
    x, y = (np.frombuffer(v, np.uint8) for v in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_or.reduce(y.reshape(-1, len(x)))).sum())


def sketches_apart(a: Column, b: Column) -> Column:
    return F.pandas_udf(lambda x, y: pd.Series([bits_apart(*v) for v in zip(x, y)], dtype="int32"), "int")(a, b)


#: Hashes in a block of sets, and what a set counts for at least.
BLOCK, LEAST = 1 << 20, 512


def cells(pairs: DataFrame, aside: bool) -> DataFrame:
    """query, match, cell of pairs with sizes n and m; ``aside`` if queries are not among the sets searched.

    Near copies of one text mostly name the same least id, their home.  A home's sets are dealt to blocks of bounded size;
    a cell is two blocks, or one.  So a set moves once for each block that its matches are in, not once a pair."""
    node = lambda id_, side: F.struct(F.lit(side).alias("side"), F.col(id_).alias("id"))
    q, m = node("query", aside), node("match", False)
    ends = F.array(F.struct(q.alias("node"), F.col("n").alias("size"), m.alias("other")), F.struct(m.alias("node"), F.col("m").alias("size"), q.alias("other")))
    homes = pairs.select(F.explode(ends).alias("e")).select("e.*").groupBy("node").agg(F.max("size").alias("size"), F.min("other").alias("other"))
    homes = kept(homes.select("node", "size", F.least("node", "other").alias("home")), "near-homes")
    parts = homes.groupBy("home").agg(F.ceil(F.sum(F.greatest("size", F.lit(LEAST))) / BLOCK).alias("parts"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), F.col("parts")))
    blocks = kept(homes.join(parts, "home").select("node", block.alias("block")), "near-blocks")
    own = lambda side, name, as_: blocks.where(F.col("node.side") == side).select(F.col("node.id").alias(name), F.col("block").alias(as_))
    placed = pairs.join(own(aside, "query", "x"), "query").join(own(False, "match", "y"), "match")
    return kept(placed.select("query", "match", F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("cell")), "near-cells")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query, match, jaccard of the pairs of each cell; its sets come before them, and are held while it lasts."""
    at, held = None, {}
    for batch in batches:
        col = {n: batch.column(n) for n in batch.schema.names}
        cell, side, set_ = col["cell"].to_numpy(), col["side"].to_pylist(), col["set"]
        ids, match = col["id"].to_pylist(), col["match"].to_pylist()
        ends, hashes, found = np.asarray(set_.offsets), np.asarray(set_.values), []
        for i, (is_pair, c) in enumerate(zip(col["pair"].to_pylist(), cell)):
            if c != at:
                at, held = c, {}
            if not is_pair:
                held[side[i], ids[i]] = np.sort(hashes[ends[i] : ends[i + 1]])
                continue
            a, b = held[side[i], ids[i]], held[False, match[i]]
            both = np.concatenate((a, b))
            both.sort(kind="stable")
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            found.append((ids[i], match[i], shared / (len(both) - shared)))
        q, m, j = zip(*found) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, col["id"].type), pa.array(m, col["match"].type), pa.array(j, pa.float64())], ["query", "match", "jaccard"])


def compared(pairs: DataFrame, sets: DataFrame, asked: DataFrame | None, id_: str) -> DataFrame:
    """query, match, jaccard of pairs with sizes n and m, each compared once on the two sets of hashes."""
    aside = asked is not None
    placed = cells(pairs, aside)
    ends = F.array(F.struct(F.lit(aside).alias("side"), F.col("query").alias(id_)), F.struct(F.lit(False).alias("side"), F.col("match").alias(id_)))
    moves = kept(placed.select("cell", F.explode(ends).alias("e")).select("cell", "e.*").distinct(), "near-moves")
    every = sets.select(F.lit(False).alias("side"), id_, "set")
    if aside:
        every = every.unionByName(asked.select(F.lit(True).alias("side"), id_, "set"))
    kind = dict(sets.dtypes)[id_]
    rows = every.join(moves, ["side", id_]).select("cell", F.lit(False).alias("pair"), "side", F.col(id_).alias("id"), F.lit(None).cast(kind).alias("match"), "set")
    rows = rows.unionByName(placed.select("cell", F.lit(True).alias("pair"), F.lit(aside).alias("side"), F.col("query").alias("id"), "match", F.lit(None).cast("array<long>").alias("set")))
    return rows.repartition("cell").sortWithinPartitions("cell", "pair").mapInArrow(_compare, f"query {kind}, match {kind}, jaccard double")


def near_matches(sets: DataFrame, queries: DataFrame, id_: str, threshold: float, both: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """query, match, jaccard of the best match of each query with another set, ties to the smaller id; sets are ``marked``.

    Two sets at the threshold share a token in their prefixes (the rarest n - ceil(t n) + 1).  A pair that meets at a
    token can only have what is left of both behind it in common, so its sizes and places must still allow the
    threshold, and so must sketches of bits, small ones within the join, then some that grow with the sets.  If every set
    is a query, ``both`` makes each pair once, the smaller set first, and counts it for both; ``asked`` has the sets of the
    queries where they are not among those searched.  Each pair that is left is verified once, on the two sets of hashes."""
    size, longs = F.size("set"), range(SET_LONGS)

    def prefixes(rows: DataFrame) -> DataFrame:
        least = F.slice("set", F.lit(1), stats.prefix_length(size, threshold))
        return rows.select(id_, size.alias("size"), *[F.get("marks", F.lit(i)).alias(f"b{i}") for i in longs], F.posexplode(least).alias("place", "token"))

    # Both sides of one table rename all, so that they are one plan, which is shuffled once.
    prefix = prefixes(sets)
    probes = prefix if asked is None else prefixes(asked)
    prefix = prefix.select(F.col(id_).alias("match"), F.col("size").alias("m"), *[F.col(f"b{i}").alias(f"m{i}") for i in longs], F.col("place").alias("j"), "token")
    probes = probes.select(F.col(id_).alias("query"), F.col("size").alias("n"), *[F.col(f"b{i}").alias(f"q{i}") for i in longs], F.col("place").alias("i"), "token")
    if both:
        fits = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("query") < F.col("match")))
    else:
        probes = probes.join(queries.select(F.col(id_).alias("query")), "query", "left_semi")
        fits = F.col("query") != F.col("match")
    # At the first common token at places i and j at most 1 + what follows in the shorter rest is shared.
    n, m = F.col("n"), F.col("m")
    needed = F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - 1e-9)
    left = 1 + F.least(n - F.col("i") - 1, m - F.col("j") - 1)
    pairs = probes.join(prefix, "token").where(fits & (F.least(n, m) >= F.greatest(n, m) * F.lit(threshold) - 1e-9))
    # Behind the first one there must be room for what is needed: what meets further back alone never leaves the join.
    apart = functools.reduce(operator.add, [F.bit_count(F.col(f"q{i}").bitwiseXOR(F.col(f"m{i}"))) for i in longs])
    pairs = pairs.where((left >= needed) & (n + m - apart >= 2 * needed)).groupBy("query", "match", "n", "m").agg(F.min(left + F.least("i", "j")).alias("most")).where(F.col("most") >= needed).select("query", "match", "n", "m")
    pairs = kept(pairs, "near-pairs")
    # Large sets fill the small sketches; those of their own size move instead of the sets, an eighth of a byte an element.
    own = sets.select(F.col(id_).alias("match"), F.col("sketch").alias("ms"))
    asking = (sets if asked is None else asked).select(F.col(id_).alias("query"), F.col("sketch").alias("qs"))
    pairs = pairs.join(asking, "query").join(own, "match").where(n + m - sketches_apart(F.col("qs"), F.col("ms")) >= 2 * needed)
    pairs = kept(pairs.select("query", "match", "n", "m"), "near-likely")
    scored = compared(pairs, sets, asked, id_).where(F.col("jaccard") >= threshold)
    if both:
        way = F.explode(F.array(F.struct("query", "match"), F.struct(F.col("match").alias("query"), F.col("query").alias("match")))).alias("w")
        scored = scored.select(way, "jaccard").select("w.*", "jaccard").join(queries.select(F.col(id_).alias("query")), "query", "left_semi")
    return scored.groupBy("query").agg(F.max_by(F.struct("match", "jaccard"), F.struct("jaccard", -F.col("match"))).alias("b")).select("query", F.col("b.match").alias("match"), F.col("b.jaccard").alias("jaccard"))


def best_matches(rows: DataFrame, id_: str, norm: str, tokens: str, threshold: float = 0.8, least_tokens: int = 4) -> DataFrame:
    """query, match, how, jaccard: for each row the first row of the same normalised text, or else the nearest text.

    Equal texts are one from the start: near matching sees each distinct text once."""
    rows = rows.select(id_, F.sha2(norm, 256).alias("same"), F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))).alias("set"))
    order = frequent_tokens(rows.select(id_, "set"), id_)
    same = kept(rows.select(id_, "same"), "near-same")
    first = same.groupBy("same").agg(F.min(id_).alias("first"))
    exact = kept(same.join(first, "same").select(id_, "first"), "near-exact")
    again = kept(exact.where(F.col(id_) != F.col("first")).select(id_), "near-again")
    sets = kept(marked(rows.join(again, id_, "left_anti").select(id_, rarest_first(F.col("set"), order).alias("set"))), "near-sets")
    near = near_matches(sets, sets.where(F.size("set") >= least_tokens), id_, threshold, both=True)
    out = exact.where(F.col(id_) != F.col("first")).select(F.col(id_).alias("query"), F.col("first").alias("match"), F.lit("exact").alias("how"), F.lit(1.0).alias("jaccard"))
    return out.unionByName(near.select("query", "match", F.lit("near").alias("how"), "jaccard"))


def index_matches(index: DataFrame, queries: DataFrame, id_: str, norm: str, tokens: str, threshold: float = 0.8, least_tokens: int = 4) -> DataFrame:
    """query, match, how, jaccard: for each query the first index row of the same normalised text, or else the nearest."""
    known = index.where(F.col(norm) != "").groupBy(norm).agg(F.min(id_).alias("match"))
    exact = queries.where(F.col(norm) != "").join(known, norm).select(F.col(id_).alias("query"), "match", F.lit("exact").alias("how"), F.lit(1.0).alias("jaccard"))
    left = queries.join(known, norm, "left_anti")
    key = F.struct(F.col("asks"), F.col(id_)).alias("key")
    both = index.select(F.lit(False).alias("asks"), id_, tokens).unionByName(left.select(F.lit(True).alias("asks"), id_, tokens)).select(key, tokens)
    sets = marked(token_sets(both, "key", tokens).select("key.asks", F.col(f"key.{id_}").alias(id_), "set"))
    asked = sets.where(F.col("asks") & (F.size("set") >= least_tokens))
    near = near_matches(sets.where(~F.col("asks")), asked.select(id_), id_, threshold, asked=asked)
    return exact.unionByName(near.select("query", "match", F.lit("near").alias("how"), "jaccard"))


def title_search(queries: DataFrame, index: DataFrame, id_: str, tokens: str, k: int = 3, least: float = 0.5, others: bool = False) -> DataFrame:
    """query, match, shared, rank: the k index titles most like each query, more words in common first, then by Jaccard, then
    by id, of those whose Jaccard similarity is at least ``least``; exact, whatever words are frequent.

    Equal titles (as sets of words) are one, which its least id stands for, on both sides; with ``others`` a title is not
    its own match.  Two titles as similar share one of their n - ceil(least n) + 1 rarest words, so only those meet.  A
    title without words has no match."""
    own = F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))
    asks = queries.select(F.col(id_).alias("query"), own.alias("own")).where(F.size("own") > 0)
    held = index.select(F.col(id_).alias("match"), own.alias("own")).where(F.size("own") > 0).groupBy("own").agg(F.min("match").alias("match"))
    titles = asks.select("own", F.lit(None).alias("match")).distinct().unionByName(held)
    flat = titles.groupBy("own").agg(F.max("match").alias("match"), F.count_if(F.col("match").isNull()).alias("asked")).withColumn("id", F.xxhash64("own"))
    flat = kept(flat.select("id", "own", "match", (F.col("asked") > 0).alias("asked")), "titles")
    words = flat.select("id", F.explode("own").alias("token"))
    df = words.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")  # a word of one title brings nobody together
    rank, many = F.row_number().over(Window.partitionBy("id").orderBy("df", "token")), F.count("*").over(Window.partitionBy("id"))
    n = F.size("own")
    marks = [set_bits(F.col("own"), i, TITLE_LONGS).alias(f"b{i}") for i in range(TITLE_LONGS)]
    ranked = words.join(df, "token").select("id", "token", rank.alias("rank"), many.alias("many"))
    rare = ranked.join(flat.select("id", n.alias("n"), "match", "asked", *marks), "id")
    # Words of one title come first in the order by frequency; they are what is missing here.
    rare = rare.withColumn("place", F.col("rank") + F.col("n") - F.col("many")).where(F.col("place") <= stats.prefix_length(F.col("n"), least))
    q = rare.where("asked").select(F.col("id").alias("q"), "token", F.col("n").alias("qn"), F.col("place").alias("i"), *[F.col(f"b{i}").alias(f"q{i}") for i in range(TITLE_LONGS)])
    m = rare.where("match IS NOT NULL").select(F.col("id").alias("m"), "token", F.col("n").alias("mn"), F.col("place").alias("j"), *[F.col(f"b{i}").alias(f"m{i}") for i in range(TITLE_LONGS)])
    # Behind the first word in common there must be room for what is needed; pairs that first meet further back are none.
    # Each bit of one title alone stands for a word of it alone, so most pairs end within the join.
    room = 1 + F.least(F.col("qn") - F.col("i"), F.col("mn") - F.col("j"))
    needed = F.ceil((F.col("qn") + F.col("mn")) * F.lit(least / (1 + least)) - 1e-9)
    apart = functools.reduce(operator.add, [F.bit_count(F.col(f"q{i}").bitwiseXOR(F.col(f"m{i}"))) for i in range(TITLE_LONGS)])
    pairs = q.join(m, "token").where((room >= needed) & (F.col("qn") + F.col("mn") - apart >= 2 * needed) & (F.least("qn", "mn") >= F.greatest("qn", "mn") * F.lit(least) - 1e-9))
    if others:
        pairs = pairs.where("q <> m")
    pairs = pairs.select("q", "m").distinct()
    a, b = flat.select(F.col("id").alias("q"), F.col("own").alias("asked_")), flat.select(F.col("id").alias("m"), F.col("own").alias("held_"), "match")
    both = pairs.join(a, "q").join(b, "m").select("q", "match", F.size(F.array_intersect("asked_", "held_")).alias("shared"), stats.set_jaccard(F.col("asked_"), F.col("held_")).alias("jaccard"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("shared"), F.desc("jaccard"), "match"))
    best = both.where(F.col("jaccard") >= least - 1e-12).withColumn("rank", best).where(F.col("rank") <= k)
    return asks.withColumn("q", F.xxhash64("own")).join(best, "q").select("query", "match", "shared", "rank")


def overlap(queries: DataFrame, index: DataFrame, id_: str, declared: str, norm: str, tokens: str) -> DataFrame:
    """queries with match, how, jaccard, declared_found (the id that they declare is in the index) and found (either)."""
    matches = index_matches(index, queries, id_, norm, tokens).withColumnRenamed("query", id_)
    ids = index.select(F.col(id_).alias(declared)).distinct().withColumn("declared_found", F.lit(True))
    out = queries.join(matches, id_, "left").join(ids, declared, "left")
    return out.withColumn("declared_found", F.coalesce("declared_found", F.lit(False))).withColumn("found", F.col(declared).isNotNull() | F.col("how").isNotNull())


def contained(queries: DataFrame, index: DataFrame, id_: str, key: str, tokens: str, threshold: float) -> DataFrame:
    """Queries that hold at least ``threshold`` of the distinct tokens of an index item: query, item, share.

    A query that does holds one of the item's size - ceil(t size) + 1 tokens that are rarest among the queries, so only
    those are probed; a pair found so is verified on the whole sets."""
    q = queries.select(F.col(id_), F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))).alias("held"))
    flat = q.select(id_, F.explode("held").alias("token"))
    items = index.select(F.col(key), F.explode(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))).alias("token"))
    df = flat.join(items.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    sets = items.join(df, "token", "left").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token"))), lambda x: x["token"]).alias("set"))
    probes = sets.select(key, F.explode(F.slice("set", F.lit(1), stats.prefix_length(F.size("set"), threshold))).alias("token"))
    pairs = flat.join(probes, "token").select(id_, key).distinct()
    share = F.size(F.array_intersect("set", "held")) / F.size("set")
    found = pairs.join(sets, key).join(q, id_).select(id_, key, share.alias("share"), F.size("set").alias("size"))
    return found.where(F.round(F.col("share") * F.col("size")) >= threshold * F.col("size")).select(id_, key, "share")
