"""Top-k with stated tie rules, seeded samples, greedy exemplars."""

from __future__ import annotations

import random
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..deploy import kept


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; Spark limits each task to k rows a group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def hash_sample(rows: DataFrame, group: list[str], id_: str, seed: int, k: int) -> DataFrame:
    """k rows a group in the order of md5(id, seed): the same on every engine that has md5."""
    return top_per_group(rows.withColumn("draw", F.md5(F.concat_ws("|", F.col(id_).cast("string"), F.lit(str(seed))))), group, [F.col("draw"), F.col(id_)], k).drop("draw")


class Ranks:
    """Rows of each group in ascending order of id, by range partitions: no task holds a group.  Rows are written once with
    their partition and place in it; ``counts`` has a row for each group and partition that it lies in."""

    def __init__(self, rows: DataFrame, group: str, id_: str):
        rows = rows.where(F.col(id_).isNotNull()).select(F.col(group).alias("group"), F.col(id_).alias("id"))
        order = (F.col("group").asc_nulls_first(), "id")
        # The third key divides even one id that very many rows repeat.
        dealt = rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order, "spread").sortWithinPartitions(*order)
        place = F.monotonically_increasing_id()
        self.rows = kept(dealt.select("group", "id", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")), "ranks")
        counts = self.rows.groupBy("group", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
        self.counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("group").orderBy("part")) - F.col("n"))

    def sizes(self) -> DataFrame:
        return self.counts.groupBy("group").agg(F.sum("n").alias("n"))

    def at(self, wanted: DataFrame) -> DataFrame:
        """group, place, id of the rows at ``rank`` (from 0) of ``wanted`` (group, place, rank)."""
        c, w = self.counts.alias("c"), wanted.alias("w")
        inside = F.col("w.group").eqNullSafe(F.col("c.group")) & (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        spots = w.join(c, inside).select("w.place", "c.part", (F.col("first") + F.col("rank") - F.col("before")).alias("spot"))
        rows = self.rows.select("group", "id", "part", F.col("place").alias("spot"))
        return rows.join(spots, ["part", "spot"]).select("group", "place", "id")


def _drawn(sizes: DataFrame, draw: Callable[[int], list[int]]) -> DataFrame:
    """group, place, rank: what ``draw`` makes of each group's count, in tasks that hold no rows of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, n in zip(frame["group"], frame["n"]):
                ranks = draw(int(n))
                yield pd.DataFrame({"group": [group] * len(ranks), "place": range(1, len(ranks) + 1), "rank": ranks})

    return sizes.mapInPandas(run, f"group {sizes.schema['group'].dataType.simpleString()}, place int, rank long")


def twister_sample(rows: DataFrame, group: str, id_: str, seed: int, k: int) -> DataFrame:
    """group, place, id: Python's random.Random(seed).sample over each group's sorted ids, bit for bit.

    The generator draws places of the sorted list, so it is run on the group's count alone, and only the rows at the k
    places drawn are fetched.  Repeated ids are rows of their own, null ids are left out, null is a group."""
    ranks = Ranks(rows, group, id_)
    return ranks.at(_drawn(ranks.sizes(), lambda n: random.Random(seed).sample(range(n), min(k, n))))


def _shuffled(n: int, seed: int, k: int) -> list[int]:
    places = array("q", range(n))
    random.Random(seed).shuffle(places)
    return places[:k].tolist()


def twister_shuffle(rows: DataFrame, group: str, id_: str, seed: int, k: int) -> DataFrame:
    """The first k of random.Random(seed).shuffle over each group's sorted ids, bit for bit, as in twister_sample.  A
    shuffle draws as often as the group has rows, one after the other: its task holds eight bytes a row, and no ids."""
    ranks = Ranks(rows, group, id_)
    return ranks.at(_drawn(ranks.sizes(), lambda n: _shuffled(n, seed, k)))


#: Terms that a task counts at a time, beyond those of one row.
TERMS = 1 << 20


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of rows with about ``TERMS`` terms, whatever the length of its lists."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        upto = max(int(np.searchsorted(ends, before + TERMS, "right")), at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def _least_of_batch(batch: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """grp, term, n and the k least ids of the terms of a batch."""
    lists, groups = batch.column("terms"), batch.column("grp").dictionary_encode("encode")
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    terms = lists.flatten().dictionary_encode("encode")
    key = np.repeat(groups.indices.to_numpy(zero_copy_only=False).astype(np.int64) * (len(terms.dictionary) or 1), size) + terms.indices.to_numpy(zero_copy_only=False)
    ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), size)
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(key)))
    # An id that repeats under a term is one.
    place = np.cumsum(fresh | np.append(True, ids[1:] != ids[:-1])[: len(key)])
    repeated = np.append(False, place[1:] == place[:-1])[: len(key)]
    kept = ~repeated & (place - np.repeat(place[first], size) < k)
    offsets = np.append(0, np.cumsum(np.add.reduceat(kept, first) if len(first) else kept)).astype(np.int32)
    grp, term = np.divmod(key[first], len(terms.dictionary) or 1)
    return pa.RecordBatch.from_arrays([groups.dictionary.take(pa.array(grp)), terms.dictionary.take(pa.array(term)), pa.array(size), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[kept]))], ["grp", "term", "n", "ids"])


def least_per_term(rows: DataFrame, k: int) -> DataFrame:
    """grp, term, n, ids: how many rows of a group have each of their ``terms`` (an array), and the k least ids of these.

    rows: grp (string), id, terms.  One aggregation: a stretch of rows, bounded in terms, counts these and keeps k ids of
    each before anything is shuffled, so a frequent term moves k ids a stretch and not its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch):
                yield _least_of_batch(rows, k)

    part = rows.select(F.col("grp").cast("string"), F.col("id").cast("long"), "terms").where("id IS NOT NULL").mapInArrow(run, "grp string, term string, n long, ids array<long>")
    least = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k)
    return part.groupBy("grp", "term").agg(F.sum("n").alias("n"), least.alias("ids"))


def greedy_exemplars(candidates: DataFrame, k: int = 3, pool: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """grp, place, term, id.  candidates (grp, score, term, id): terms by falling score, then falling term, each take
    their least id that no other has taken, k at most; with ``pool`` (grp, id) what is then missing is filled with its
    least free ids, without a term.

    What was passed over stays taken, so each choice is the best of all that is free: k rounds of one aggregation that
    combines before its shuffle, exact for any number of candidates.  A term with k ids or more always has a free one, so
    what ranks below the k-th such term of its group cannot be chosen, and of each term its k least ids are enough.
    ``keep`` may write what is read again."""
    rows = candidates.select("grp", F.col("score").cast("double").alias("score"), "term", "id")
    terms = rows.groupBy("grp", "score", "term").agg(F.count_distinct("id").alias("ids"))
    floor = top_per_group(terms.where(F.col("ids") >= k), ["grp"], [F.desc("score"), F.desc("term")], k).where(F.col("rank") == k)
    floor = floor.select("grp", F.struct("score", "term").alias("floor"))
    rows = rows.join(floor, "grp", "left").where(F.col("floor").isNull() | (F.struct("score", "term") >= F.col("floor"))).drop("floor")
    rows = top_per_group(rows.distinct(), ["grp", "score", "term"], [F.col("id")], k).select("grp", F.lit(1).alias("named"), "score", "term", "id")
    if pool is not None:
        pool = top_per_group(pool.select("grp", "id").distinct(), ["grp"], [F.col("id")], k)
        rows = rows.unionByName(pool.select("grp", F.lit(0).alias("named"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("term"), "id"))
    rows = keep(rows, "exemplar-candidates")
    best = F.max_by(F.struct("term", "id"), F.struct("named", "score", "term", -F.col("id"))).alias("b")
    picks = keep(rows.groupBy("grp").agg(best).select("grp", F.lit(1).alias("place"), "b.*"), "exemplar-picks")
    for place in range(2, k + 1):
        # k rows a group at most have been picked.
        free = rows.join(picks.select("grp", "id"), ["grp", "id"], "left_anti").alias("f")
        free = free.join(picks.select("grp", "term").where("term IS NOT NULL"), ["grp", "term"], "left_anti")
        picks = keep(picks.unionByName(free.groupBy("grp").agg(best).select("grp", F.lit(place).alias("place"), "b.*")), "exemplar-picks")
    return picks


def first_of_leading(rows: DataFrame, group: str, label: str, id_: str, most: int = 3) -> DataFrame:
    """group, label, id, is_leading: the first row by id of the most frequent label that has one (rows where ``fits``),
    among the ``most`` most frequent labels of the group, ties by label."""
    counts = rows.groupBy(group, label).agg(F.count("*").alias("n"), F.min(F.when(F.col("fits"), F.col(id_))).alias(id_))
    top = top_per_group(counts, [group], [F.desc("n"), F.col(label)], most).where(F.col(id_).isNotNull())
    return top.groupBy(group).agg(F.min_by(F.struct(label, id_, (F.col("rank") == 1).alias("is_leading")), "rank").alias("b")).select(group, "b.*")
