"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Features of a text, each present or not: its words and word pairs, and runs of one to three word shapes (letter
cases, digits, punctuation, and whether a word repeats the one before).  Every indicator is scaled by the log ratio
of its class rates (naive Bayes), rows are brought to length one, and a linear hinge-loss model is fitted by dual
coordinate descent.  Margins become probabilities by a sigmoid fitted to cross-validated margins.

The fit sees at most ``SAMPLE`` labelled rows, chosen by a hash of their ids from those whose crc32(doc_id) mod 4 is
not 2; scoring sees every text whole.  Null and empty texts have no features and score by the bias alone.  Labels
that are null are ignored; a doc_id labelled twice counts with its lower label, one with several texts with the least of
them; repeated rows score alike.  With fewer than two classes to learn from, every text scores that class's rate (0.5
without any label).  Ties among ids in the sample go to the smaller id, a score equal to the threshold passes.  Empty
tables give no rows.  A text of any length is read in blocks; its distinct features must fit in memory.  Other columns
are kept, and the two new ones get fresh names where theirs are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import ORDER, cuts, give_back, lean, mix, shingles, word_hashes, word_spans
from .shared import fresh

SAMPLE, LEAST_DOCS, THRESHOLD = 6000, 4, 0.7

_UPPER, _LOWER_CASE, _DIGIT, _MARK = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LOWER_CASE[97:123] = _LOWER_CASE[128:] = True
_DIGIT[48:58] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MARK_VALUE = np.where(_MARK, mix(np.arange(256, dtype=np.uint64) + np.uint64(7)), np.uint64(0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _shapes(b: np.ndarray) -> np.ndarray:
    """A hash of each word's shape: which kinds of characters it has, and its punctuation."""
    out = []
    for s, e in cuts(b):
        part = b[s:e]
        starts, _ = word_spans(part)
        if not len(starts):
            continue
        kinds = [np.add.reduceat(t[part].astype(np.int64), starts) for t in (_UPPER, _LOWER_CASE, _DIGIT)]
        marks = np.add.reduceat(_MARK_VALUE[part], starts)
        code = np.minimum(kinds[0], 2) * 4 + (kinds[1] > 0) * 2 + (kinds[2] > 0)
        out.append(mix(marks + code.astype(np.uint64) * ORDER[50]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def features(b: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit features of a text."""
    words = word_hashes(b)
    if not len(words):
        return words
    shape = _shapes(b)
    again = np.zeros(len(words), np.uint64)
    again[1:] = words[1:] == words[:-1]
    shape = mix(shape + again * ORDER[51])
    parts = [words, shingles(words, 2) + np.uint64(1)]
    parts += [mix(shingles(shape, k) + np.uint64(100 + k)) for k in (1, 2, 3)]
    return np.unique(np.concatenate(parts))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    good, bad = (smooth + np.bincount(np.concatenate([r for r, t in zip(rows, y) if (t > 0) == side] or [np.zeros(0, np.int64)]), minlength=size) for side in (True, False))
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 12, seed: int = 1) -> np.ndarray:
    """Weights (the last is the bias) of a linear hinge-loss model; y is 1 or -1."""
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)).tolist():
            row, value = rows[i], values[i]
            slope = y[i] * (float(w[row] @ value) + w[size]) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), cost)
            step = (new - alpha[i]) * y[i]
            if step:
                w[row] += step * value
                w[size] += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton's method on smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, beta = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


class Model:
    """vocabulary: sorted feature hashes; weight: model weight times log ratio; square: squared log ratio."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, square: np.ndarray, bias: float, a: float, b: float):
        self.vocabulary, self.weight, self.square, self.bias, self.a, self.b = vocabulary, weight, square, bias, a, b

    def score(self, text: np.ndarray) -> float:
        found = locate(self.vocabulary, features(text))
        margin = self.bias
        if len(found):
            margin += float(self.weight[found].sum()) / max(float(self.square[found].sum()) ** 0.5, 1e-9)
        return float(1 / (1 + np.exp(-np.clip(self.a * margin + self.b, -30, 30))))


def locate(vocabulary: np.ndarray, found: np.ndarray) -> np.ndarray:
    if not len(vocabulary) or not len(found):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
    return at[vocabulary[at] == found]


def vocabulary(found: np.ndarray, least: int = LEAST_DOCS) -> np.ndarray:
    """Sorted features that at least ``least`` documents have; ``found``: each document's, once each."""
    found = np.sort(found)
    first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[first[np.diff(np.append(first, len(found))) >= least]]


def fit(rows: list[np.ndarray], labels: np.ndarray, names: np.ndarray, folds: int = 3) -> Model:
    """rows: places in the vocabulary ``names`` of each document's features."""
    y = np.where(labels > 0, 1.0, -1.0)
    none = np.zeros(0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        rate = float((y > 0).mean()) if len(y) else 0.5
        return Model(np.zeros(0, np.uint64), none, none, 0.0, 1.0, float(np.clip(np.log((rate + 1e-9) / (1 - rate + 1e-9)), -30, 30)))

    def train(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = log_count_ratios([rows[i] for i in at], y[at], len(names))
        values = [unit(r[rows[i]]) for i in at]
        return dual_coordinate_descent([rows[i] for i in at], values, y[at], len(names)), r

    fold, margin = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        if len(set(y[fold != k])) < 2:
            continue
        w, r = train(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margin[i] = float(w[rows[i]] @ unit(r[rows[i]])) + w[-1]
    a, b = sigmoid_fit(margin, y)
    w, r = train(np.arange(len(y)))
    return Model(names, w[:-1] * r, r * r, float(w[-1]), a, b)


def unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(v @ v) ** 0.5, 1e-9)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernels import texts

        for batch in batches:
            found = [features(t).view(np.int64) for t in texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "y", "f"])

    # At most ``sample`` rows of two numbers are broadcast, and as many feature lists come to the driver.
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").cast("int").alias("y"))
    found = joined.mapInArrow(lean(run), "doc_id long, y int, f array<long>").toArrow()
    order, y = np.argsort(found.column("doc_id").to_numpy()), found.column("y").to_numpy()
    lists = found.column("f").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], lists.type)
    del found
    values, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    names = vocabulary(values)
    rows = [locate(names, values[ends[i - 1] if i else 0 : ends[i]]) for i in order.tolist()]
    del lists, values  # the driver holds one form of the features at a time
    model = fit(rows, y[order], names)
    give_back()
    return model


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, names: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with two columns more: the score, and 1 if it reaches ``threshold``, else 0; unless they are given, their
    names are quality_score and quality_pass, made fresh where ``docs`` has them."""
    names = names or (fresh("quality_score", docs.columns), fresh("quality_pass", docs.columns))
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fitting sample
    schema = ["`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernels import texts

        for batch in batches:
            score = np.array([held.value.score(t) for t in texts(batch.column("text"))], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names, *names])

    return docs.mapInArrow(lean(run), ", ".join([*schema, f"`{names[0]}` double", f"`{names[1]}` int"]))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score_quality(docs.select(F.col("doc_id").cast("long"), "text"), fit_quality(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_pass").alias("predicted"))
