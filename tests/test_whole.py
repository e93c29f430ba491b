"""Queries do the whole job: no row, key or label is left aside."""

import duckdb
from conftest import SF, rows_of
from pyspark.sql import functions as F

from corpusmill.plans import flows, labels, pages, records


def test_retag(spark, duck, tmp_path):
    labels.store_labels(labels.docs(spark, SF), str(tmp_path / "labels"))
    stored = spark.read.parquet(str(tmp_path / "labels"))
    want = duck.sql(f"{labels._L} SELECT doc_id, labels FROM l").fetchall()
    assert sorted((r.doc_id, r.labels) for r in stored.collect()) == sorted(want)
    assert labels.differing(stored).first() == (len(want), 0)
    # A stale list that only lacks its last label, or is null, counts.
    long = sum(len(x) > 1 for _, x in want)
    stale = stored.withColumn("labels", F.when(F.size("labels") > 1, F.slice("labels", 1, F.size("labels") - 1)).otherwise(F.col("labels")))
    assert long and labels.differing(stale).first() == (len(want), long)
    assert labels.differing(stored.withColumn("labels", F.when(F.size("labels") < 2, F.col("labels")))).first() == (len(want), long)


def test_round_trip(spark, duck, tmp_path):
    got = {r.file: r.n for r in flows.jsonl_round_trip(spark, SF).collect()}
    assert got == {f"{s}.jsonl": n for s, n in duck.sql("SELECT source, count(*) FROM documents GROUP BY 1").fetchall()} and "src0.jsonl" in got
    odd = 'a "b"\n{c}\r\u2028\\ é\x00'
    rows = [(1, odd, "src0"), (2, None, "src0"), (3, odd * 2, None), (None, "x", None), (4, "y", ""), (5, "z", "null"), (6, "w", "a/b=c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in flows.jsonl_round_trip(spark, str(tmp_path)).select("file", "n", "ids", "longest").collect()}
    assert got == {("src0.jsonl", 2, 2, len(odd)), ("no source", 2, 1, 2 * len(odd)), (".jsonl", 1, 1, 1), ("null.jsonl", 1, 1, 1), ("a/b=c.jsonl", 1, 1, 1)}


def test_parsed_key(spark, duck):
    got = sorted(tuple(r) for r in records.join_on_parsed_key(spark, SF).select("key", "p_size", "p_brand").collect())
    assert got == duck.sql("SELECT p_partkey, p_size, p_brand FROM part ORDER BY 1").fetchall() and got[-1][0] > 100


def test_supplement(spark, duck):
    got = sorted(tuple(r) for r in flows._supplemented(spark, SF).collect())
    assert got == duck.sql("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY 1").fetchall() and len(got) > 100


def test_article_text(spark, tmp_path):
    """Against its SQL, on cut references, odd spaces, empty, open, nested and several articles, and repeated page ids."""
    inner = ["<h1>t = &quot</h1><p>a &quot;b&quot; &amp c &amp;amp; &amp;quot; &lt;x&gt; &copy; &#38; & &am</p>", "", "words", "<br>", "a<br>b <i>c</i> d<p>e<b>f</b>g</p>", " \xa0\u2003 x\x0by\xa0\n\f z\u3000", "<script>var a = '<p>';</script><!-- <b> -->x < y", "<article>a</article>b"]
    html = [f"<html><body><p>0</p><article>{x}</article><p>after</p></body></html>" for x in inner]
    html += ["<article>open <b>x", "<article>one<p></p></article><i></i><article>two</article>", "<article class='a'>x</article>", "<ARTICLE>x</ARTICLE>", "no article", "", None, "<article>x\n"]
    rows = [*enumerate(html), (0, html[2]), (None, html[0])]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = pages.html_article_text(spark, str(tmp_path))
    assert dict(got.dtypes) == {"page_id": "bigint", "node_id": "int", "whole": "string", "nodes": "bigint"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(pages.registry.sql["html_article_text"]).df()
    assert rows_of(got.toPandas()) == rows_of(want) and len(want) == 13
