"""Exact self-join of documents by Jaccard similarity of word n-gram sets, in a metric space with pivots.

Jaccard distance is a metric.  Documents gather in Voronoi regions around pivots, boundary documents stand in several
regions, and each region is joined exactly, its own members serving as pivots whose distances bound all others by the
triangle inequality.  Far from any pivot all distances are 1, so a few global pivots would tell nothing apart; the
first division is therefore around leaders that share rare n-grams:

1. Equal sets become one.  The least hashes of a set, ``n - ceil(t n) + l`` of them, are its probe: two linked sets
   have their least common n-grams, ``l`` at least, in both probes.  N-grams that a sample of the table shows to be
   common rank last, so a probe seldom holds them.
2. Per n-gram, sets of compatible sizes with it in their probes form a cell; the cell's leader is its least set.  A set
   whose cells with company are fewer than ``l`` has no link and leaves.  The others belong to the regions of their
   cells' leaders, but for those of fewest cells, ``(l - 1) / 2`` cells in all: two linked sets share ``l`` cells and
   lose fewer, so they keep a region in common.  Cells of common n-grams take their leader from the sample, so that
   their members need not meet to choose it.
3. A region above ``MEMBERS`` sets is divided (``_divided``): distances to ``PIVOTS`` of its members give links at once;
   each set goes to its nearest pivot, and to every other whose distance is within twice the threshold of that, so that
   linked sets meet in the Voronoi cell of either.  Cells in which all are one component already are done, small ones are
   joined, large ones are divided again with new pivots.  Where pivots do not tell the sets apart (windows that would
   replicate each set ``SPREAD`` times) and more than ``MEMBERS`` are outside the largest component, the region is divided
   by what is rare within it (``_by_rare_grams``): of its n-grams, least frequent in the region first, a set's first
   ``n - ceil(t n) + 1`` hold one of each linked set, so sets that only share what all have never meet.  What is outside
   the largest component of a region that is left meets all, block by block.
4. In a small region pivots are taken in turn: the set with most open pairs is compared with all others; links unite
   components; a pair is open while its components differ, its sizes allow a link and every pivot leaves
   ``|d(x, p) - d(y, p)|`` within the threshold.  The region ends when no pair is open, which is exact.

Empty or null texts, and texts without words, have the empty set, link with nothing, and are their own component.
Repeated rows and equal texts have equal sets and one component; two texts under one doc_id are two documents.  A null
doc_id stands for its text; component_id is the least doc_id that is not null.  Empty tables give no rows.  Only doc_id
and text are read, so other columns never clash; n-gram and set hashes have 64 bits.  A text's set must fit in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import lean, packed, shingles, texts, unpacked, word_hashes
from .shared import fresh, identity, keyed, shuffle_partitions, staged

MEMBERS, EXTRA, CELL_ENTRIES, TASK_BYTES, CHUNK_BYTES = 1024, 0.04, 500_000, 8 << 20, 12 << 20
#: Sets in the sample at most; an n-gram is common if it is in about COMMON sets of the whole table, and in LEAST_HITS of
#: the sample, which is more where the sample is a small share (one set in a thousand).
SAMPLE, COMMON, LEAST_HITS = 16_384, 1000, 16
PIVOTS, SPREAD, HOT_LEADER, FEW_LEADERS = 32, 3, 4096, 100_000


class Rule(NamedTuple):
    """words: n; two sets link when ``den * intersection >= num * union``."""

    words: int = 4
    num: int = 85
    den: int = 100

    def floor(self, n: np.ndarray) -> np.ndarray:
        """The least intersection that a set of n can have with a linked one."""
        return -(-n * self.num // self.den)

    def extra(self, n: np.ndarray) -> np.ndarray:
        return 1 + np.floor(EXTRA * n).astype(np.int64)

    def probe(self, n: int) -> int:
        n_ = np.array([n])
        return int(min(n, (n_ - self.floor(n_) + self.extra(n_))[0]))

    def needed(self, n: np.ndarray) -> np.ndarray:
        """Cells with company that a linked set of n has at least: l of the smallest size it can link with."""
        return self.extra(self.floor(n))


def shingle_set(b: np.ndarray, words: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(b), words))


def signature(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sig = [], []
            for b in texts(batch.column("text")):
                s = shingle_set(b, rule.words)
                n.append(len(s))
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("t"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.int64())], ["k", "t", "doc_id", "n", "sig"])

    return run


class Common(NamedTuple):
    """Common n-grams, sorted, and the leader of each one's cell."""

    grams: np.ndarray
    leaders: np.ndarray

    def at(self, s: np.ndarray) -> np.ndarray:
        """Place of each n-gram among the common ones, or -1."""
        if not len(self.grams):
            return np.full(len(s), -1)
        at = np.minimum(np.searchsorted(self.grams, s), len(self.grams) - 1)
        return np.where(self.grams[at] == s, at, -1)


def common_grams(source: DataFrame, sets: DataFrame, rule: Rule, distinct: int) -> Common:
    """Common n-grams by a sample of distinct sets; they only steer the order of probes.  The sample is by hash, so it
    needs no sort, and bounded by SAMPLE however many sets there are."""
    share = min(1.0, SAMPLE / max(distinct, 1))
    least = max(LEAST_HITS, int(COMMON * share))
    drawn = sets.where("n > 0").where(F.pmod(F.xxhash64("sig"), F.lit(1 << 31)) < int(share * (1 << 31)))
    chosen = drawn.groupBy("sig").agg(F.min(F.struct("k", "t")).alias("at")).select("at.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in texts(batch.column("text")):
                s = shingle_set(b, rule.words)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), signature(s)))], ["gram", "sig"])

    rows = source.join(F.broadcast(chosen), ["k", "t"], "left_semi").select("text").mapInArrow(lean(run), "gram long, sig long")
    found = rows.groupBy("gram").agg(F.count("*").alias("c"), F.min("sig").alias("leader")).where(F.col("c") >= least).toArrow()
    grams = found.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return Common(grams[order], found.column("leader").to_numpy()[order])


CELLS = "part int, gram binary, sig binary, n binary, leader long, member long, size long, cells long"


def _probes(rule: Rule, common: Common, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            grams, sigs, sizes, hot, held = [], [], [], [], 0
            for b in texts(batch.column("text")):
                s = shingle_set(b, rule.words)
                if not len(s):
                    continue
                sig = signature(s)
                if sig in met:
                    continue
                met.add(sig)
                place = common.at(s)
                probe = np.concatenate([np.flatnonzero(place < 0), np.flatnonzero(place >= 0)])[: rule.probe(len(s))]
                cold = probe[place[probe] < 0]
                if len(cold):
                    grams.append(s[cold])
                    sigs.append(np.full(len(cold), sig))
                    sizes.append(np.full(len(cold), len(s)))
                    held += len(cold)
                if len(cold) < len(probe):
                    leaders, cells = np.unique(common.leaders[place[probe[len(cold) :]]], return_counts=True)
                    hot += [(int(a), sig, len(s), int(c)) for a, c in zip(leaders, cells)]
                if held > 400_000:
                    yield _cells(grams, sigs, sizes, parts)
                    grams, sigs, sizes, held = [], [], [], 0
            if len(met) > 400_000:
                met.clear()
            if held:
                yield _cells(grams, sigs, sizes, parts)
            if hot:  # nothing to bring together: dealt by member
                z = pa.array([None] * len(hot), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([h[1] % parts for h in hot], pa.int32()), z, z, z, *[pa.array(c, pa.int64()) for c in zip(*hot)]], [x.split()[0] for x in CELLS.split(", ")])

    return run


def _cells(grams: list, sigs: list, sizes: list, parts: int) -> pa.RecordBatch:
    g = np.concatenate(grams)
    cells = packed((g % np.uint64(parts)).astype(np.int64), {"gram": g, "sig": np.concatenate(sigs), "n": np.concatenate(sizes).astype(np.int64)})
    z = pa.array([None] * len(cells), pa.int64())
    return pa.RecordBatch.from_arrays([*cells.columns, z, z, z, z], [x.split()[0] for x in CELLS.split(", ")])


REGION = "leader long, member long, size long, cells long"


def _company(rule: Rule):
    """Cells with company: per leader and member, how many cells they share, each cell cut where sizes cannot link."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        hot = table.filter(pc.is_null(table.column("gram"))).select(["leader", "member", "size", "cells"]).group_by(["leader", "member", "size"]).aggregate([("cells", "max")])
        hot = hot.rename_columns({"cells_max": "cells"})
        table = table.filter(pc.is_valid(table.column("gram")))
        g, sig, n = unpacked(table, "gram", "<u8"), unpacked(table, "sig", "<i8"), unpacked(table, "n", "<i8")
        order = np.lexsort((sig, n, g))
        g, sig, n = g[order], sig[order], n[order]
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (sig[1:] != sig[:-1])  # sets that several tasks have sent
        g, sig, n = g[keep], sig[keep], n[keep]
        cut = np.ones(len(g), bool)
        cut[1:] = (g[1:] != g[:-1]) | (n[:-1] < rule.floor(n[1:]))
        starts = np.flatnonzero(cut)
        counts = np.diff(np.append(starts, len(g)))
        leader = np.repeat(np.minimum.reduceat(sig, starts), counts) if len(g) else sig
        many = np.repeat(counts > 1, counts)
        leader, sig, n = leader[many], sig[many], n[many]
        order = np.lexsort((sig, leader))
        leader, sig, n = leader[order], sig[order], n[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (leader[1:] != leader[:-1]) | (sig[1:] != sig[:-1])
        first = np.flatnonzero(fresh)
        cold = pa.table({"leader": leader[first], "member": sig[first], "size": n[first], "cells": np.diff(np.append(first, len(sig)))})
        return pa.concat_tables([cold, hot.select(cold.column_names)])

    return run


class Region:
    """Sets of one region; ``settle`` finds a link between any two components that have one."""

    def __init__(self, sets: list[np.ndarray], rule: Rule, component: np.ndarray | None = None):
        self.rule, self.m = rule, len(sets)
        self.n = np.array([len(s) for s in sets], dtype=np.int64)
        self.starts = np.cumsum(self.n) - self.n
        names, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.mark = np.zeros(len(names), bool)
        self.component = np.arange(self.m) if component is None else np.unique(component, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def overlaps(self, i: int) -> np.ndarray:
        mine = self.code[self.starts[i] : self.starts[i] + self.n[i]]
        self.mark[mine] = True
        out = np.add.reduceat(self.mark[self.code].astype(np.int64), self.starts)
        self.mark[mine] = False
        return out

    def settle(self, asked: np.ndarray | None = None) -> list[tuple[int, int]]:
        """asked: only pairs with one of these count (others are settled elsewhere)."""
        rule = self.rule
        small, large = np.minimum(self.n[:, None], self.n), np.maximum(self.n[:, None], self.n)
        open_ = small >= rule.floor(large)
        if asked is not None:
            open_ &= asked[:, None] | asked
        slack = 1 - rule.num / rule.den + 1e-9
        open_ &= self.component[:, None] != self.component
        turn = open_.sum(axis=1)
        while turn.any():
            i = int(np.argmax(turn))
            both = self.overlaps(i)
            union = self.n + self.n[i] - both
            far = 1 - both / union
            linked = (rule.den * both >= rule.num * union) & (self.component != self.component[i])
            for j in np.flatnonzero(linked).tolist():
                if self.component[j] != self.component[i]:
                    self.links.append((i, j))
                    self.component[self.component == self.component[j]] = self.component[i]
            open_[i, :] = open_[:, i] = False
            rows = np.flatnonzero(turn)
            if len(rows):
                open_[rows] &= (np.abs(far[rows, None] - far) <= slack) & (self.component[rows, None] != self.component)
            turn = open_.sum(axis=1)
        return self.links


def _bodies(table: pa.Table, name: str = "body") -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u8") for x in table.column(name).to_pylist()]


EDGE = "a long, b long"


def _edges(left: list[int], right: list[int]) -> pa.Table:
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _region_task(rule: Rule):
    """Regions of one task, each joined on its own; where there is a label, equal ones are linked already."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("region", "ascending"), ("member", "ascending")])
        region, member = (table.column(c).to_numpy() for c in ("region", "member"))
        label = table.column("label").to_numpy() if "label" in table.column_names else member
        cut = np.concatenate([[0], np.flatnonzero(np.diff(region)) + 1, [len(table)]])
        left, right = [], []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            at = a + np.unique(member[a:b], return_index=True)[1]
            if len(at) < 2:
                continue
            for i, j in Region(_bodies(table.take(pa.array(at))), rule, label[at]).settle():
                left.append(int(member[at[i]]))
                right.append(int(member[at[j]]))
        return _edges(left, right)

    return run


def _block_task(rule: Rule):
    """A chunk of a region against some of the sets outside its largest component."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("outside", "descending"), ("member", "ascending")])
        member, label, outside = (table.column(c).to_numpy(zero_copy_only=False) for c in ("member", "label", "outside"))
        at = np.sort(np.unique(member, return_index=True)[1])
        if len(at) < 2:
            return _edges([], [])
        found = Region(_bodies(table.take(pa.array(at))), rule, label[at]).settle(outside[at].astype(bool))
        return _edges([int(member[at[i]]) for i, _ in found], [int(member[at[j]]) for _, j in found])

    return run


PLACED = "region long, member long, label long, cells array<int>, links array<long>"


def _placed(rule: Rule):
    """Links of some members of a region to its pivots, and the Voronoi cells that each belongs to."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        member, pivots = left.column("member").to_numpy(), right.column("pivots")[0].as_py() if len(right) else []
        if not len(member) or not pivots:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))], names=[x.split()[0] for x in PLACED.split(", ")])
        ids, k = np.array([p["member"] for p in pivots]), len(pivots)
        region = Region([*(np.frombuffer(p["body"], dtype="<u8") for p in pivots), *_bodies(left)], rule)
        far, linked, among = np.empty((k, len(member))), np.zeros((k, len(member)), bool), np.zeros((k, k), bool)
        for i in range(k):
            both = region.overlaps(i)
            union = region.n + region.n[i] - both
            near = rule.den * both >= rule.num * union
            far[i], linked[i], among[i] = 1 - both[k:] / union[k:], near[k:], near[:k]
        for _ in range(k):  # the least pivot of each component of pivots, the same in every chunk
            ids_ = np.where(among, ids, np.iinfo(np.int64).max).min(axis=1)
            among = among | (ids_[:, None] == ids_)
        label = np.where(linked.any(axis=0), ids_[linked.argmax(axis=0)], member)
        inside = far <= far.min(axis=0) + 2 * (1 - rule.num / rule.den) + 1e-9
        cells = [np.flatnonzero(x).astype(np.int32) for x in inside.T]
        links = [ids[x & (ids != m)] for x, m in zip(linked.T, member)]
        return pa.table([left.column("region"), pa.array(member), pa.array(label), pa.array(cells, pa.list_(pa.int32())), pa.array(links, pa.list_(pa.int64()))], names=[x.split()[0] for x in PLACED.split(", ")])

    return run


def _exhaustive(rows: DataFrame, rule: Rule, members: int) -> DataFrame:
    """Links of the sets outside each region's largest component with all its sets, in blocks.  rows: region, member,
    label, body."""
    count = rows.groupBy("region", "label").agg(F.count("*").alias("c"))
    main = count.groupBy("region").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("most")).where("m > most")
    main = main.select("region", "main", F.ceil((F.col("m") - F.col("most")) / members).alias("blocks"), F.ceil(F.col("m") / members).alias("chunks"))
    own = _with_region(rows, main, "blocks * chunks").withColumn("outside", F.col("label") != F.col("main"))
    spot = F.xxhash64("member", F.lit(1))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = own.where("outside").select("region", F.pmod(spot, F.col("blocks")).alias("block"), every("chunks").alias("chunk"), "member", "label", "outside", "body")
    rest = own.select("region", every("blocks").alias("block"), F.pmod(F.xxhash64("member"), F.col("chunks")).alias("chunk"), "member", "label", F.lit(False).alias("outside"), "body")
    return asked.unionByName(rest).groupBy("region", "chunk", "block").applyInArrow(_block_task(rule), EDGE)


def _dealt_grams(parts: int):
    """n-grams of many sets by part, packed: region, member, size of the set and n-gram of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "member"))
            sets, since, held = _bodies(batch), 0, 0
            for i, s in enumerate(sets):
                held += len(s)
                if held < 1 << 18 and i < len(sets) - 1:
                    continue
                n = np.array([len(x) for x in sets[since : i + 1]], dtype=np.int64)
                grams = np.concatenate(sets[since : i + 1])
                each = [np.repeat(x, n) for x in (region[since : i + 1], member[since : i + 1], n)]
                yield packed((grams % np.uint64(parts)).astype(np.int64), dict(zip(("regions", "members", "sizes", "grams"), (*each, grams))))
                since, held = i + 1, 0

    return run


SHARED_GRAM = "region long, member long, n long, gram long, times long"


def _shared_grams(key: tuple, table: pa.Table) -> pa.Table:
    """The n-grams of a part that several sets of a region have, a row a set, with how many have it."""
    region, member, n, gram = (unpacked(table, c, "<i8") for c in ("regions", "members", "sizes", "grams"))
    order = np.lexsort((member, gram, region))
    region, member, n, gram = (x[order] for x in (region, member, n, gram))
    once = np.ones(len(gram), bool)  # a row of documents that repeats brings its set again
    once[1:] = (region[1:] != region[:-1]) | (gram[1:] != gram[:-1]) | (member[1:] != member[:-1])
    region, member, n, gram = (x[once] for x in (region, member, n, gram))
    first = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (gram[1:] != gram[:-1])])) if len(gram) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(gram)))
    times = np.repeat(times, times)
    some = times > 1
    return pa.table([pa.array(x[some]) for x in (region, member, n, gram, times)], names=[x.split()[0] for x in SHARED_GRAM.split(", ")])


def _rare_companies(rows: DataFrame, rule: Rule) -> DataFrame:
    """region, leader, member: the companies of sets of a region that may be linked: those with a rare n-gram in common,
    under the least set of it.  A linked set has more n-grams in common than ``floor``, so one without as many shared ones
    leaves at once.  Each n-gram of each set moves once."""
    parts = max(shuffle_partitions(rows.sparkSession), int(rows.agg(F.sum(F.octet_length("body")).alias("n")).first().n or 0) * 4 // TASK_BYTES + 1)
    dealt = rows.select("region", "member", "body").mapInArrow(lean(_dealt_grams(parts)), "part int, regions binary, members binary, sizes binary, grams binary")
    shared = dealt.groupBy("part").applyInArrow(_shared_grams, SHARED_GRAM)
    own = Window.partitionBy("region", "member")
    private = F.col("n") - F.count("*").over(own)
    place = F.row_number().over(own.orderBy("times", "gram"))
    prefix = F.col("n") - F.ceil(F.col("n") * rule.num / rule.den) + 1
    rare = staged(shared.withColumn("place", place + private).where(F.col("place") <= prefix).select("region", "member", "gram"), "jaccard-rare")
    leader = rare.groupBy("region", "gram").agg(F.min("member").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c")
    return rare.join(leader, ["region", "gram"]).select("region", "leader", "member").distinct()


def _by_rare_grams(rows: DataFrame, rule: Rule, members: int) -> list[DataFrame]:
    """Links of regions (region, member, label, body) whose sets are alike in what is frequent there."""
    companies = _rare_companies(rows, rule)
    name = F.xxhash64("region", "leader", F.lit("rare"))
    inner = companies.join(rows, ["region", "member"]).select(name.alias("region"), "member", "label", "body")
    sizes = inner.groupBy("region").agg(F.count("*").alias("m"), F.sum(F.octet_length("body")).alias("bytes"), F.min("label").alias("low"), F.max("label").alias("high"))
    sizes = sizes.where("low <> high").select("region", "m", ((F.col("m") > members) | (F.col("bytes") > CHUNK_BYTES)).alias("large"))
    inner = staged(_with_region(inner, staged(sizes, "jaccard-rare-sizes"), "m").select("region", "member", "label", "large", "body"), "jaccard-rare-regions", "lz4")
    return [_small_regions(inner.where("NOT large"), rule), _exhaustive(inner.where("large").drop("large"), rule, members)]


def _small_regions(rows: DataFrame, rule: Rule) -> DataFrame:
    """Links of regions that a task can join, as many to a task as fit."""
    tasks = max(shuffle_partitions(rows.sparkSession), int(rows.agg(F.sum(F.octet_length("body")).alias("n")).first().n or 0) // TASK_BYTES)
    task = F.pmod(F.xxhash64("region"), F.lit(tasks)).alias("task")
    return rows.select(task, "region", "member", "label", "body").groupBy("task").applyInArrow(_region_task(rule), EDGE)


def _not_told_apart(rows: DataFrame, rule: Rule, members: int) -> list[DataFrame]:
    """Links of large regions (region, member, label, body) whose sets pivots do not tell apart: where few are outside the
    largest component, these meet all; else the region is divided by its rare n-grams."""
    count = rows.groupBy("region", "label").agg(F.count("*").alias("c"))
    outside = count.groupBy("region").agg((F.sum("c") - F.max("c")).alias("outside"), F.sum("c").alias("m")).where("outside > 0")
    outside = staged(outside, "jaccard-outside")
    few, many = (outside.where(x).select("region", "m") for x in (F.col("outside") <= members, F.col("outside") > members))
    found = [_exhaustive(_with_region(rows, few, "m").drop("m"), rule, members)]
    if not many.isEmpty():
        found += _by_rare_grams(staged(_with_region(rows, many, "m").drop("m"), "jaccard-alike", "lz4"), rule, members)
    return found


def _with_region(rows: DataFrame, regions: DataFrame, hot: str, key: str = "region") -> DataFrame:
    """rows joined with what is known of their regions (one row each).  Regions of many rows (``hot`` is above
    HOT_LEADER) are broadcast if there are few of them, so that their rows stay where they are."""
    large = regions.where(F.expr(hot) > HOT_LEADER)
    if not 0 < large.limit(FEW_LEADERS + 1).count() <= FEW_LEADERS:
        return rows.join(regions, key)
    small = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(regions.where(F.expr(hot) <= HOT_LEADER), key)
    return rows.join(F.broadcast(large), key).unionByName(small)


def _divided(rows: DataFrame, rule: Rule, members: int, pivots: int) -> DataFrame:
    """Links of large regions (region, member, body) by Voronoi cells of pivots, again and again until cells are small."""
    found, depth = [], 0
    while True:
        sizes = rows.groupBy("region").agg(F.count("*").alias("m"), F.sum(F.octet_length("body")).alias("bytes"))
        sizes = staged(sizes.select("region", "m", F.greatest(F.ceil(F.col("m") / members), F.ceil(F.col("bytes") / CHUNK_BYTES)).alias("chunks")), "jaccard-sizes")
        rank = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64("member", F.lit(depth)), "member"))
        picks = rows.select("region", "member").withColumn("rank", rank).where(F.col("rank") <= pivots).drop("rank")
        chosen = rows.join(picks, ["region", "member"]).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("member", "body"))).alias("pivots"))
        chosen = staged(chosen, "jaccard-pivots")
        dealt = _with_region(rows, sizes, "m").withColumn("chunk", F.pmod(F.xxhash64("member", F.lit(~depth)), F.col("chunks")))
        each = chosen.join(sizes, "region").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        keys = ("region", "chunk")
        placed = dealt.select("region", "chunk", "member", "body").groupBy(*keys).cogroup(each.select("region", "chunk", "pivots").groupBy(*keys)).applyInArrow(_placed(rule), PLACED)
        placed = staged(placed, "jaccard-placed")
        found.append(placed.select(F.col("member").alias("a"), F.explode("links").alias("b")))
        cells = placed.select("region", "member", "label", F.explode("cells").alias("cell"))
        per = cells.groupBy("region", "cell").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high"))
        spread = per.groupBy("region").agg(F.sum("c").alias("stood")).join(sizes, "region").withColumn("told_apart", F.col("stood") <= SPREAD * F.col("m"))
        per = staged(per.where("low <> high").join(spread, "region"), "jaccard-cells")
        name = F.xxhash64("region", "cell", F.lit(depth)).alias("next")
        live = per.where("told_apart").select("region", "cell", name, (F.col("c") > members).alias("large"), (F.col("c") > 0.7 * F.col("m")).alias("whole"))
        inner = cells.join(live, ["region", "cell"]).join(rows.select("region", "member", "body"), ["region", "member"])
        inner = staged(inner.select(F.col("next").alias("region"), "member", "label", "large", "whole", "body"), "jaccard-inner", "lz4")
        found.append(_small_regions(inner.where("NOT large"), rule))
        found += _not_told_apart(inner.where("large AND whole").select("region", "member", "label", "body"), rule, members)
        alike = per.where("NOT told_apart").select("region").distinct()
        stuck = rows.join(placed.join(alike, "region", "left_semi").select("region", "member", "label"), ["region", "member"])
        found += _not_told_apart(stuck.select("region", "member", "label", "body"), rule, members)
        found = [staged(f.select("a", "b"), "jaccard-links") for f in found]
        rows, depth = inner.where("large AND NOT whole").select("region", "member", "body"), depth + 1
        if rows.limit(1).count() == 0:
            return _union(found)
        found = [_union(found)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def components(edges: DataFrame) -> DataFrame:
    """sig, label of every end of the edges: each round every vertex takes the least of its neighbours, edges between
    what has become one vanish; rounds grow with the logarithm of the number of vertices."""
    edges = staged(edges.distinct(), "jaccard-edges")
    labels = edges.select(F.col("a").alias("sig")).union(edges.select("b")).distinct().select("sig", F.col("sig").alias("label"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("v"), F.least("a", "p").alias("p"))
        parent = staged(parent, "jaccard-parents")
        labels = staged(labels.join(parent, labels.label == parent.v, "left").select("sig", F.coalesce("p", "label").alias("label")), "jaccard-labels")
        one = edges.join(parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        edges = staged(one.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "jaccard-edges")
    return labels


def linked_components(docs: DataFrame, rule: Rule = Rule(), members: int = MEMBERS, pivots: int = PIVOTS) -> DataFrame:
    """k, t, doc_id, n_shingles, component_id, and first (k and t of its component's first document) of each row."""
    spark, source = docs.sparkSession, keyed(docs)
    sets = staged(source.mapInArrow(lean(_sets(rule)), "k long, t long, doc_id long, n long, sig long"), "jaccard-sets")
    total = sets.agg(F.sum("n").alias("n"), F.approx_count_distinct("sig").alias("sets")).first()
    parts = max(shuffle_partitions(spark), int((total.n or 0) * (1 - rule.num / rule.den + EXTRA)) // CELL_ENTRIES + 1)
    common = common_grams(source, sets, rule, total.sets)
    cells = source.select("text").mapInArrow(lean(_probes(rule, common, parts)), CELLS)
    shared = staged(cells.groupBy("part").applyInArrow(_company(rule), REGION), "jaccard-shared")
    needed = 1 + F.floor(F.lit(EXTRA) * F.ceil(F.col("size") * rule.num / rule.den))
    whole = shared.groupBy("member", "leader").agg(F.sum("cells").alias("cells"), F.max("size").alias("size"))
    rising = Window.partitionBy("member").orderBy("cells", "leader").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = whole.withColumn("upto", F.sum("cells").over(rising)).withColumn("all", F.sum("cells").over(Window.partitionBy("member")))
    regions = staged(ranked.where((F.col("all") >= needed) & (F.col("upto") > F.floor((needed - 1) / 2))).select("leader", "member", "size"), "jaccard-members")
    big = regions.groupBy("leader").agg(F.count("*").alias("m"), F.sum("size").alias("grams")).where("m > 1")
    big = staged(big.select("leader", "m", ((F.col("m") > members) | (F.col("grams") * 8 > CHUNK_BYTES)).alias("large")), "jaccard-leaders")
    regions = staged(_with_region(regions, big, "m", "leader"), "jaccard-regions")
    first = sets.where("n > 0").groupBy(F.col("sig").alias("member")).agg(F.min(F.struct("k", "t")).alias("at")).select("member", "at.*")
    wanted = regions.groupBy("member").agg(F.collect_list(F.struct("leader", "large")).alias("regions")).join(first, "member")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for b, member, own in zip(texts(batch.column("text")), batch.column("member").to_pylist(), batch.column("regions").to_pylist()):
                body = shingle_set(b, rule.words).astype("<u8").tobytes()
                for r in own:
                    out.append((r["leader"], member, r["large"], body))
                    held += len(body)
                if held > 8 << 20:
                    yield _shipped(out)
                    out, held = [], 0
            yield _shipped(out)

    shipped = source.select("k", "t", "text").join(wanted.select("k", "t", "member", "regions"), ["k", "t"]).mapInArrow(lean(ship), SHIPPED)
    large = big.where("large").limit(1).count() > 0
    if large:
        shipped = staged(shipped, "jaccard-shipped", "lz4")
    tasks = max(shuffle_partitions(spark), int(regions.agg(F.sum("size").alias("g")).first().g or 0) * 8 // TASK_BYTES)
    task = F.pmod(F.xxhash64("region"), F.lit(tasks)).alias("task")
    edges = shipped.where("NOT large").select(task, "region", "member", "body").groupBy("task").applyInArrow(_region_task(rule), EDGE)
    if large:
        edges = edges.unionByName(_divided(shipped.where("large").select("region", "member", "body"), rule, members, pivots))
    labels = components(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    sig = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "k", "t")).alias("first"))
    sig = sig.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    whole = sig.groupBy("label").agg(F.min("low").alias("component_id"), F.min("first").alias("first"))
    sig = staged(sig.select("sig", "label").join(whole, "label").select("sig", "component_id", F.struct("first.k", "first.t").alias("first")), "jaccard-components")
    out = sets.join(sig, "sig", "left")
    none = F.col("n") == 0
    return out.select("k", "t", "doc_id", F.col("n").alias("n_shingles"), F.when(none, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(none, F.struct("k", "t")).otherwise(F.col("first")).alias("first"))


SHIPPED = "region long, member long, large boolean, body binary"


def _shipped(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, types)], [x.split()[0] for x in SHIPPED.split(", ")])


def component_digest(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    return linked_components(docs, rule).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, each once.  Two texts under one doc_id that don't link
    both stay."""
    names = [fresh(f"jaccard_{c}", docs.columns) for c in ("k", "t")]
    kept = staged(linked_components(docs, rule).where(F.col("first") == F.struct("k", "t")).groupBy("k", "t").agg(F.count("*").alias("rows")), "jaccard-kept")
    own = docs.withColumns(dict(zip(names, identity(F.col("doc_id"), F.col("text")))))
    out = own.join(kept.select(F.col("k").alias(names[0]), F.col("t").alias(names[1])), names, "left_semi")
    if kept.where("rows > 1").limit(1).count():  # rows that repeat a document
        out = out.dropDuplicates(names)
    return out.select(*docs.columns)
