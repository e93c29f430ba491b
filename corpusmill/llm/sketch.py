"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash (48 bits) below a fixed fraction of the hash range, so sketches of texts of any sizes
can be united, and containment and Jaccard estimated, from the sketches alone.  So that short texts have evidence too,
the ``LEAST`` smallest hashes are kept even above the threshold; a text with fewer shingles keeps all.  Up to which hash
a sketch is complete can be read off it (``reach``), and two sketches are compared up to the smaller of their reaches.
Texts with fewer words than a shingle are one shingle.  A fingerprint is the sketch's hashes, ascending, as
hexadecimal digits, 12 each: about a tenth of the text.

Null and empty texts, and texts of white space alone, have the empty fingerprint; two empty sketches are alike (1),
an empty and another are not (0).  A containment is null where the larger sketch is complete up to no hash of the
smaller: there is no evidence.  Rows with the same doc_id follow each other by text hash; null doc_ids come first.  A
doc_id with more rows than a part has, null included, is divided by text hash; rows that repeat both stay together.  A table of one row is its own next document.  An empty table gives
no rows.  A text and its edited form must fit in memory.  Only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean, shingles, word_hashes
from .shared import identity, shuffle_partitions

FRACTION, LEAST, WORDS, BITS = 1 / 32, 20, 5, 48
ALL = 1 << BITS


def threshold(fraction: float) -> int:
    return int(fraction * ALL)


def _scaled(h: np.ndarray, fraction: float) -> np.ndarray:
    return h[: max(min(LEAST, len(h)), int(np.searchsorted(h, threshold(fraction))))]


def sketch(text: str | bytes, fraction: float = FRACTION, words: int = WORDS) -> np.ndarray:
    raw = text.encode() if isinstance(text, str) else text
    return _scaled(np.unique(shingles(word_hashes(np.frombuffer(raw, dtype=np.uint8)), words) >> np.uint64(64 - BITS)).astype(np.int64), fraction)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of the union of two shingle sets."""
    return _scaled(np.union1d(a, b), fraction)


def reach(a: np.ndarray, fraction: float = FRACTION) -> int:
    """Every hash of the text up to this one is in its sketch."""
    if len(a) < LEAST:
        return ALL
    return max(int(a[-1]), threshold(fraction) - 1) if len(a) == LEAST else threshold(fraction) - 1


def hexadecimal(h: np.ndarray) -> str:
    return "".join(f"{x:012x}" for x in h.tolist())


def _common(a: np.ndarray, b: np.ndarray, fraction: float) -> tuple[int, int, int]:
    """Sizes of both and of what they share, up to the smaller reach."""
    top = min(reach(a, fraction), reach(b, fraction))
    a, b = a[: np.searchsorted(a, top, side="right")], b[: np.searchsorted(b, top, side="right")]
    return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """Jaccard estimate: of the hashes either text has up to the smaller reach, the part that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    x, y, both = _common(a, b, fraction)
    return both / (x + y - both)


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float | None:
    """Estimate of the part of a's shingles that b has; None without evidence."""
    if not len(a) or not len(b):
        return float(not len(a))
    x, _, both = _common(a, b, fraction)
    return both / x if x else None


def edit(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


LEAST_LONG = -(2**63)


def _splits(ids: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where about ``parts`` parts begin: text hashes for null doc_ids; doc_id and text hash for the others.  A doc_id with
    more rows than a part has is divided by text hash (hashes are spread evenly); of the others, doc_ids are quantiles.
    As many numbers as there are partitions, about."""
    total = ids.count()
    often = ids.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") * parts > total).collect()
    own = {r.doc_id: -(-parts * r.n // total) for r in often}
    begin = {i: [LEAST_LONG + (j << 64) // n for j in range(1, n)] for i, n in own.items()}
    heavy = [i for i in own if i is not None]
    rest, n = ids.where(F.col("doc_id").isNotNull() & ~F.col("doc_id").isin(heavy)), total - sum(r.n for r in often)
    cells = -(-parts * n // max(total, 1))
    found = rest.select(F.col("doc_id").cast("double").alias("q")).approxQuantile("q", [i / cells for i in range(1, cells)], 1 / (4 * cells)) if cells > 1 else []
    pairs = sorted({(int(x), LEAST_LONG) for x in found} | {(i, LEAST_LONG) for i in heavy} | {(i, t) for i in heavy for t in begin[i]})
    return tuple(np.array(x, dtype=np.int64) for x in (begin.get(None, []), [i for i, _ in pairs], [t for _, t in pairs]))


def _parts_of(batch: pa.RecordBatch, splits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Part of each row; the parts of null doc_ids come first."""
    nulls, starts, hashes = splits
    null = pc.is_null(batch.column("doc_id")).to_numpy(zero_copy_only=False)
    ids, t = pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False), batch.column("t").to_numpy(zero_copy_only=False)
    below, upto = (np.searchsorted(starts, ids, side=x) for x in ("left", "right"))
    for a in np.unique(below[upto > below]).tolist():  # doc_ids that begin a part, or several
        mine = (below == a) & (upto > below)
        e = int(np.searchsorted(starts, starts[a], side="right"))
        below[mine] = a + np.searchsorted(hashes[a:e], t[mine], side="right")
    return np.where(null, np.searchsorted(nulls, t, side="right"), len(nulls) + 1 + below).astype(np.int32)


def fingerprints(docs: DataFrame, fraction: float = FRACTION, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the containments.

    Texts move once: to the part that their doc_id falls into.  The first document of each part (and, after the last
    part, the first of all) is also sent to the part before, so that each part knows its last document's next.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), identity(F.col("doc_id"), text)[1].alias("t"), text.alias("text"))
    ids = keyed.select("doc_id", "t")
    splits = _splits(ids, shuffle_partitions(spark))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            part = _parts_of(batch, splits)
            order = pc.sort_indices(pa.table([batch.column("doc_id"), batch.column("t")], names=["doc_id", "t"]), sort_keys=[("doc_id", "ascending"), ("t", "ascending")]).to_numpy()
            for i in order[np.unique(part[order], return_index=True)[1]].tolist():
                low = (batch.column("doc_id")[i].as_py(), batch.column("t")[i].as_py())
                found[int(part[i])] = min(found.get(int(part[i]), low), low, key=lambda x: (x[0] or 0, x[1]))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())], ["part", "doc_id", "t"])

    # One row a part: the place of its first document.
    firsts = ids.mapInArrow(lean(least), "part int, doc_id long, t long").groupBy("part").agg(F.min(F.struct("doc_id", "t")).alias("f")).collect()
    order = sorted(r.part for r in firsts)
    number = {p: i for i, p in enumerate(order)}
    before = {(r.f.doc_id, r.f.t): (number[r.part] - 1) % len(order) for r in firsts}  # a part's first document -> the part before

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, dense = ["part", "guest", "doc_id", "t", "text"], np.array(order, dtype=np.int32)
        hashes = pa.array([t for _, t in before], pa.int64())
        for batch in batches:
            part = np.searchsorted(dense, _parts_of(batch, splits)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(batch), np.int8)), *batch.columns], names)
            likely = batch.filter(pc.is_in(batch.column("t"), value_set=hashes))
            to = [before.get(x) for x in zip(likely.column("doc_id").to_pylist(), likely.column("t").to_pylist())]
            guests = likely.filter(pa.array([x is not None for x in to], pa.bool_()))
            if len(guests):
                yield pa.RecordBatch.from_arrays([pa.array([x for x in to if x is not None], pa.int32()), pa.array(np.ones(len(guests), np.int8)), *guests.columns], names)

    dealt = keyed.mapInArrow(lean(deal), "part int, guest byte, doc_id long, t long, text string")
    dealt = dealt.repartitionById(max(1, len(order)), "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "t", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_in_edited", "contained_in_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, doc_id, text and sketch of the document whose next has not come yet
        rows: list[tuple] = []
        weight = 0
        for batch in batches:
            for part, guest, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")]):
                own = sketch(text, fraction, words)
                if held is not None and held[0] == part:
                    changed = edit(held[2], text)
                    raw = changed.encode()
                    other = sketch(raw, fraction, words)
                    rows.append((held[1], len(held[2]), hashlib.sha256(raw).hexdigest(), hexadecimal(held[3]), hexadecimal(other), likeness(held[3], other, fraction), likeness(held[3], own, fraction), containment(held[3], other, fraction), containment(held[3], own, fraction)))
                    weight += len(rows[-1][3]) + len(rows[-1][4])
                held = None if guest else (part, doc_id, text, own)
                if weight > 8 << 20:
                    yield _rows(rows, names)
                    rows, weight = [], 0
        yield _rows(rows, names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_edited double, contained_in_next double"
    return dealt.mapInArrow(lean(run), schema)


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)
