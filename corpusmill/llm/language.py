"""Language ID by multilingual mixture inference.

Each language has a distribution over hashed byte trigrams of lower-cased letters, counted over all documents to
learn from.  A document's trigrams are modelled as drawn from a mixture of languages: expectation-maximisation
estimates the proportions, and the set of languages is the one of the best likelihood less a penalty for each further
language (languages are tried in order of their proportion).  The language of the greatest proportion is predicted,
with that proportion as score.

A text that is null or has no letter is ``und`` with score 0; so is every text if there is nothing to learn from.
Null lang values are not learned.  Repeated rows are predicted alike; texts of any length are counted whole, in
stretches of 1 MB, into 65,536 counts.  Only text, and lang of documents whose crc32(doc_id) mod 4 is not 2, are
inputs; other columns are not read.  Ties between languages go to the name that sorts first.  Empty tables give no
rows.  A model has 512 KB a language and goes to every worker, so there may be MOST_LANGUAGES of them; a table with more
values of lang is an error, not a smaller model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BLOCK, lean, texts
from .quality import held_out

BITS, SMOOTH, PENALTY, ROUNDS, MOST_LANGUAGES = 16, 0.5, 4.0, 25, 500
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_GAP = np.full(1, 0x20, dtype=np.uint8)


def trigrams(b: np.ndarray) -> np.ndarray:
    """Hashes of the byte trigrams of a text's letters, cases folded (of ASCII and Latin-1), gaps as one space."""
    b = np.concatenate([_GAP, b, _GAP])
    lead = np.zeros(len(b), bool)
    lead[1:] = b[:-1] == 0xC3
    t = _FOLD[b]
    t = np.where(lead & (b >= 0x80) & (b <= 0x9E) & (b != 0x97), t + np.uint8(0x20), t).astype(np.uint32)
    gap = t == 0x20
    keep = np.ones(len(t), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    t = t[keep]
    h = (t[:-2] << np.uint32(16)) | (t[1:-1] << np.uint32(8)) | t[2:]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def counts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram hashes of a text and how often each occurs."""
    if len(b) <= 8192:
        return np.unique(trigrams(b), return_counts=True)
    total = np.zeros(1 << BITS, np.int64)
    for a in range(0, len(b), BLOCK):
        total += np.bincount(trigrams(b[max(0, a - 2) : a + BLOCK]), minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    """names: languages in order; p: trigram hash x language, probabilities."""

    def __init__(self, names: list[str], n: np.ndarray):
        self.names = names
        if names:
            self.common = int(np.argmax(n.sum(axis=0)))
            self.share = float(n[:, self.common].sum() / max(n.sum(), 1))
        self.p = (n + SMOOTH) / (n.sum(axis=0, keepdims=True) + SMOOTH * n.shape[0])

    def mixture(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation, and the log likelihood."""
        total, share = n.sum(), np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(ROUNDS if p.shape[1] > 1 else 0):
            weight = p * share
            new = (n / weight.sum(axis=1)) @ weight / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, b: np.ndarray) -> list[tuple[str, float]]:
        """The selected languages and their proportions, greatest first."""
        if not self.names:
            return []
        at, n = counts(b)
        if not len(at):  # letters of which no byte trigram is left: the commonest language
            return [(self.names[self.common], self.share)]
        p, n = self.p[at], n.astype(np.float64)
        share, _ = self.mixture(p, n)
        first = int(np.argmax(n @ np.log(p)))
        order = [first, *[j for j in np.argsort(-share, kind="stable").tolist() if j != first]]
        best, chosen = (np.ones(1), self.mixture(p[:, [first]], n)[1]), [first]
        fine = PENALTY * np.log(max(n.sum(), 2.0))
        for k in range(2, len(order) + 1):
            if share[order[k - 1]] < 0.02:
                break
            found = self.mixture(p[:, order[:k]], n)
            if found[1] - best[1] <= fine:
                break
            best, chosen = found, order[:k]
        ranked = sorted(zip(best[0].tolist(), chosen), key=lambda x: (-x[0], x[1]))
        return [(self.names[j], s) for s, j in ranked]


def fit_languages(docs: DataFrame) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, b in zip(batch.column("lang").to_pylist(), texts(batch.column("text"))):
                mine = total.setdefault(lang, np.zeros(1 << BITS, np.int64))
                at, n = counts(b)
                mine[at] += n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    # As many rows as there are languages times 65,536 at most, whatever the number of documents.
    if known.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values of lang: these are not language codes")
    found = known.mapInArrow(lean(run), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    table = np.zeros((1 << BITS, len(names)))
    place = {x: i for i, x in enumerate(names)}
    table[found.column("gram").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    return Model(names, table)


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, langs (array of the selected set, with proportions)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.infer(b) if letters else [] for letters, b in zip(batch.column("letters").to_pylist(), texts(batch.column("text")))]
            top = [x[0] if x else (UNKNOWN, 0.0) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in top], pa.string()), pa.array([min(1.0, x[1]) for x in top], pa.float64()), pa.array([[f"{a}:{s:.4f}" for a, s in x] for x in found], pa.list_(pa.string()))],
                ["doc_id", "lang_pred", "score", "langs"],
            )

    asked = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    out = asked.mapInArrow(lean(run), "doc_id long, lang_pred string, score double, langs array<string>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")


def language_digest(docs: DataFrame) -> DataFrame:
    return predict_languages(docs, fit_languages(docs))
