"""The pipeline stage by stage against brute-force versions on the smallest tables."""

from collections import Counter

from conftest import SF
from test_llm_operators import brute_components, covered

import corpus_pipeline
from corpusmill.llm import jaccard
from corpusmill.llm.shared import staged


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(staged(stage(spark, kept[-1], SF), "stage"))
    table = [[r.asDict() for r in k.collect()] for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])

    ids = [{r["doc_id"] for r in t} for t in table]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels[i] == 1 for i in ids[0] - ids[1] if i in labels) <= 0.05 * sum(labels.values())
    # Some sixty labels to learn from at this size, a sixth of them bad: most of the bad ones must go all the same.
    bad = [i for i in ids[0] if labels.get(i) == 0]
    assert len(set(bad) & ids[1]) <= len(bad) / 2

    found = brute_components(sorted((r["doc_id"], r["text"] or "") for r in table[1]), jaccard.Rule(5, 80, 100))
    assert ids[2] == {i for i, (_, c) in found.items() if i == c}

    texts = sorted((r["doc_id"], (r["text"] or "").encode()) for r in table[2])
    cov = covered(texts, corpus_pipeline.PASSAGE_BYTES, True)
    after = {r["doc_id"]: r for r in table[3]}
    for i, t in texts:
        least = bytes(x for x, m in zip(t, cov[i]) if not m)
        assert len(least) <= len(after[i]["text"].encode()) <= len(least) + 6 * 8
        assert after[i]["n_chars"] == len(after[i]["text"])

    copies = Counter(r["doc_id"] for r in table[4])
    assert set(copies) <= ids[3] and max(copies.values()) <= 2
    words = {r["doc_id"]: len((r["text"] or "").split()) for r in table[3]}
    assert abs(sum(words[i] * n for i, n in copies.items()) / (1.5 * sum(words.values())) - 1) < 0.1

    packed = Counter()
    for r in table[5]:
        if r["start"] == 0:
            packed[r["doc_id"]] += 1
    assert packed == copies
    assert corpus_pipeline.run(spark, SF).count() == len(table[5])


def test_awkward_tables(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names, and empty tables, stage by
    stage: no row is lost that the stage has no reason to drop, and columns stay as they are."""
    from pyspark.sql import functions as F
    from test_llm_operators import EDGE, SCHEMA

    rows = [*EDGE, (4, "another text under the same id as before, long enough for shingles", "en", "b", 70), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("k", "t", "part", "size", "spans_text", "jaccard_k", "quality_score", "mix_copies", "region"):
        docs = docs.withColumn(c, F.lit("clash"))
    for table, some in ((docs, True), (docs.limit(0), False)):
        for name, stage in corpus_pipeline.STAGES:
            got = staged(stage(spark, table, SF), "awkward")
            assert (got.count() > 0) == some, name
            if name != "packing":
                assert got.columns == table.columns and got.schema.simpleString() == table.schema.simpleString(), name
    one = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert one.count() == len(rows) - 1 and one.where("doc_id = 4").count() == 2  # the repeated row is one
    assert corpus_pipeline.cut_repeated_passages(spark, docs, SF).count() == len(rows)
    assert corpus_pipeline.pack_sequences(spark, docs, SF).where("start = 0").count() == len(rows)
