"""A training-data pipeline over ``documents``: five stages, each one of the operators in ``corpusmill.llm``.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and its result is written as Parquet and
read again as the next one's ``docs``.  All but the last return the columns that they got, others than those of
``documents`` too, whatever their names.

Every stage takes null values in any column, empty and very long texts, repeated rows and empty tables; what it does with
them is said below.  A table without rows gives none at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import jaccard, mixing, packing, quality, substrings
from corpusmill.llm.shared import fresh, mark, staged, sweep, table

#: Bytes of a repeated passage, above any single stock line; and words of one that has fewer bytes: over 50.
PASSAGE_BYTES = 256
PASSAGE_WORDS = 51


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted to ``labels``, doesn't reject.  A null text counts as empty, and all empty texts
    have one score; rows that repeat a document are judged alike; a repeated doc_id counts once in the fit; without labels
    every score is 0.5, which is below the threshold, and all go."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    score, passed = fresh("quality_score", docs.columns), fresh("quality_pass", docs.columns)
    return quality.score_quality(docs, model, names=(score, passed)).where(F.col(passed) == 1).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near copies: five words, similarity 0.8.  First is the least doc_id, then the
    least text hash; a null doc_id stands for its text and comes last.  Documents without words have no copies and stay;
    rows that repeat doc_id and text are one."""
    return jaccard.one_of_each(docs, jaccard.Rule(5, 80, 100))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document (or an earlier place) has; the first copy stays.  Of equal texts
    the least doc_id is earlier, a null one stands for its text; a null text stays null, a text that is all repeats becomes
    empty."""
    return substrings.without_repeats(docs, PASSAGE_BYTES, "first", words=PASSAGE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: each document as often as the mix takes it.  A null source is a source; documents
    without words are taken for certain or not at all; rows that share or lack a doc_id are decided one by one."""
    return mixing.repeated(mixing.pareto_mix(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences.  A null or empty text is its end id alone; rows that repeat are
    documents of their own."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("suffix-array dedup", cut_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: Training, set joins, suffix order and packing have no SQL form; run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0])
        sweep(spark, since, keep=docs)  # the tables of the stages so far are not read again
    return STAGES[-1][1](spark, docs, sf_dir)
