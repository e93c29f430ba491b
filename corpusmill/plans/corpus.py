"""Corpora as files: line scans, documents, feeds, recorded pages, and what an analysis publishes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import records as P
from ..sources import jsonl, paged
from .common import Registry, scratch, table
from .shares import _W, events, ratio_sql
from .shares import window_share_ratio as share_table

registry = Registry()

_WIN = "CASE WHEN n_chars >= 1500 THEN 'trailing' WHEN n_chars >= 500 THEN 'preceding' END"


def _corpus(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON Lines files by source, as a harvest leaves it: a tenth of the lines broken, a tenth blank, a
    sixth of the records once more under another title in the last file, and a folder of raw files that is no corpus."""
    folder, d = scratch(spark, "corpus"), table(spark, sf_dir, "documents")
    k, title = F.col("doc_id"), F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    window = F.when(F.col("n_chars") >= 1500, "trailing").when(F.col("n_chars") >= 500, "preceding")
    fields = [F.concat(F.lit("doc:"), k.cast("string")).alias("id"), F.when(k % 4 > 0, F.coalesce("source", F.lit("unknown"))).alias("server"), title.alias("title"), F.substr(F.coalesce("text", F.lit("")), F.length(title) + 2).alias("abstract"), window.alias("window"), F.array(F.coalesce("lang", F.lit("xx")), F.lit("all")).alias("matched_terms")]
    good = F.to_json(F.struct(*fields))
    lines = d.select(F.coalesce("source", F.lit("unknown")).alias("file"), F.when(k % 10 == 3, F.concat(F.lit("{"), good)).when(k % 10 == 7, F.lit("  ")).otherwise(good).alias("line"))
    again = d.where((k % 6 == 0) & ~(k % 10).isin(3, 7)).select(F.lit("zz").alias("file"), F.to_json(F.struct(fields[0], F.coalesce("source", F.lit("unknown")).alias("server"), F.lit("again").alias("title"), window.alias("window"))).alias("line"))
    jsonl.publish(lines.unionByName(again), folder, "file", text=True)
    folder = jsonl.published(spark, folder)
    lines.where(k % 10 == 3).select("line").write.text(f"{folder}/raw")
    return folder


@registry.add("SELECT coalesce(source, 'unknown') AS file, count(*) FILTER (doc_id % 10 NOT IN (3, 7)) AS n, count(*) FILTER (doc_id % 10 = 3) AS bad FROM documents WHERE doc_id % 10 <> 7 GROUP BY 1 UNION ALL SELECT 'zz', count(*), 0 FROM documents WHERE doc_id % 6 = 0 AND doc_id % 10 NOT IN (3, 7)")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of all corpus files, not of folders inside, with the malformed lines of each; blank lines are
    none."""
    rows = jsonl.read_corpus(spark, _corpus(spark, sf_dir), keep_bad=True)
    file = F.regexp_replace("file", r"-\d+\.jsonl$", "")
    return rows.groupBy(file.alias("file")).agg(F.count("id").alias("n"), F.count("bad").alias("bad"))


_SCANNED = f"""s AS (SELECT doc_id, coalesce(source, 'unknown') AS server, 0 AS lane, split_part(coalesce(text, ''), chr(10), 1) AS title, {_WIN} AS win FROM documents WHERE doc_id % 10 NOT IN (3, 7)
UNION ALL SELECT doc_id, coalesce(source, 'unknown'), 1, 'again', {_WIN} FROM documents WHERE doc_id % 6 = 0 AND doc_id % 10 NOT IN (3, 7))"""


@registry.add(f"WITH {_SCANNED}, f AS (SELECT server, doc_id, arg_min(title, lane) AS title FROM s WHERE win IS NOT NULL GROUP BY 1, 2) SELECT server, count(*) AS n, sum(length(title))::BIGINT AS letters, count(*) FILTER (title = 'again') AS again FROM f GROUP BY 1")
def windowed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in a window, server from the file name where they name none, the first of each (server, id)."""
    rows = jsonl.windowed(jsonl.read_corpus(spark, _corpus(spark, sf_dir)))
    return rows.groupBy("server").agg(F.count("*").alias("n"), F.sum(F.length("title")).alias("letters"), F.count_if(F.col("title") == "again").alias("again"))


@registry.add(f"WITH {_SCANNED} SELECT 'doc:' || doc_id::VARCHAR AS id, title, win AS \"window\" FROM s WHERE server = 'src1' AND lane = 0 AND doc_id % 4 > 0")
def lookup_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id, title and window of one server's records; other fields are never parsed out of the lines."""
    rows = jsonl.read_corpus(spark, _corpus(spark, sf_dir), schema="id string, server string, title string, window string")
    return rows.where("server = 'src1' AND file NOT LIKE 'zz%'").select("id", "title", "window")


@registry.add("SELECT n_nationkey AS key, n_name AS name, [n_regionkey::VARCHAR, 'r'] AS spans FROM nation")
def json_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array over many lines, read with its types checked."""
    path = scratch(spark, "document")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.array(F.col("n_regionkey").cast("string"), F.lit("r")).alias("spans"))
    # A document of one small table: one row.
    n.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*n.columns))), {"pretty": "true"}).alias("value")).write.text(path)
    return jsonl.read_json_array(spark, path, "key int, name string, spans array<string>")


@registry.add("SELECT r_regionkey::BIGINT AS region, 40 + r_regionkey AS total, count(n_nationkey) + (r_regionkey % 2)::INT AS n_entries, CASE WHEN r_regionkey % 2 = 1 THEN 'incorrect id' END AS error, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS titles FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def atom_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds with what the service has in all, their entries, and error entries told apart."""
    path, r = scratch(spark, "feeds"), F.col("n_regionkey")
    entry = F.concat(F.lit("<entry><id>n"), F.col("n_nationkey").cast("string"), F.lit("</id><title> "), "n_name", F.lit("\n </title><summary>s</summary><published>2024-02-0"), (r + 1).cast("string"), F.lit("T00:00:00Z</published><author><name>A B</name></author><author><name>C</name></author></entry>"))
    feeds = table(spark, sf_dir, "nation").groupBy(r.alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", entry.alias("e")))), lambda x: x["e"]), "").alias("entries"))
    error = F.when(F.col("r") % 2 == 1, "<entry><id>error</id><title>Error</title><summary>incorrect id</summary></entry>").otherwise("")
    feeds.select("r", F.concat(F.lit('<feed xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/"><title>q</title><opensearch:totalResults>'), (40 + F.col("r")).cast("string"), F.lit("</opensearch:totalResults>"), "entries", error, F.lit("</feed>")).alias("value")).write.partitionBy("r").text(path)  # a file a feed
    f = jsonl.read_feeds(spark, path)
    return f.select((F.col("total") - 40).alias("region"), F.col("total").cast("int").alias("total"), "n_entries", "error", F.array_join(F.transform("entries", lambda e: e["title"]), ",").alias("titles"))


@registry.add("WITH f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ORDER BY k LIMIT 200), n AS (SELECT k, (row_number() OVER (ORDER BY k) - 1) // 20 AS request FROM f) SELECT request, array_to_string(list(k ORDER BY k), ',') AS ids, (SELECT greatest(count(DISTINCT l_orderkey) - 200, 0) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS left_over FROM n GROUP BY 1")
def id_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by id for what is cited and not known yet, twenty ids each, ten at most, and how many ids are left."""
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    return paged.id_batches(cited, known, "k").select("request", F.array_join("ids", ",").alias("ids"), "left_over")


_PAGE, _CAP = 50, 180


def _recorded(spark: SparkSession, sf_dir: str, style: str) -> DataFrame:
    """Pages of events by type as a harvest saved them, one page of each type of more than five lost and one cut short."""
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    rows = e.select(F.col("event_type").alias("slice"), "event_id", place.alias("i"), F.count("*").over(Window.partitionBy("event_type")).alias("total"))
    rows = rows.withColumn("page", F.floor(F.col("i") / _PAGE))
    item = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("i").alias("n")))
    pages = rows.groupBy("slice", "page", "total").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", item.alias("x")))), lambda x: x["x"]).alias("items"))
    position = F.col("page") * _PAGE if style == "offset" else F.col("page") + 1
    name = lambda p: F.when(p == 0, "*").otherwise(F.concat(F.lit("c"), F.crc32(F.concat_ws("/", "slice", p.cast("string")).cast("binary")).cast("string")))
    last = F.col("page") == F.floor((F.col("total") - 1) / _PAGE)
    path = scratch(spark, "pages")
    pages.select("slice", position.alias("position"), name(F.col("page")).alias("cursor"), F.when(~last, name(F.col("page") + 1)).alias("next"), "total", "items", "page").write.partitionBy("slice").json(path)
    return paged.recorded_pages(spark, path)


_EV = f"e AS (SELECT event_type AS slice, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS total FROM events), p AS (SELECT slice, i // {_PAGE} AS page, any_value(total) AS total, count(*) AS held FROM e GROUP BY ALL)"


@registry.add(f"WITH {_EV} SELECT slice, total, least(sum(held), {_CAP})::BIGINT AS fetched, count(*) AS pages, total > {_CAP} AND sum(held) >= {_CAP} AS truncated, true AS done FROM p GROUP BY 1, 2")
def slice_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each slice's recorded pages hold, up to a cap, whether it was cut there, and whether it is done."""
    return paged.slice_log(_recorded(spark, sf_dir, "offset"), _CAP)


@registry.add(f"WITH {_EV} SELECT slice, (page + 1)::BIGINT AS position, CASE WHEN page = 1 THEN NULL ELSE held - 3 END AS held, CASE WHEN page = 1 THEN NULL ELSE held END AS due FROM p WHERE page = 1 OR page = 2")
def page_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered pages that are missing (the second) or shorter than they should be (the third)."""
    pages = _recorded(spark, sf_dir, "number")
    broken = pages.where("position <> 2").withColumn("items", F.when(F.col("position") == 3, F.slice("items", F.lit(1), F.size("items") - 3)).otherwise(F.col("items")))
    return paged.page_problems(broken, _PAGE, "number")


@registry.add(f"WITH {_EV} SELECT slice, count(*) AS n, sum(event_id)::BIGINT AS ids, max(i)::BIGINT AS last FROM e WHERE i < {_CAP} GROUP BY 1")
def cursor_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of cursor pages, put in order by each page's next cursor, up to a cap."""
    items = paged.page_items(paged.ordered_by_cursor(_recorded(spark, sf_dir, "cursor"), -(-_CAP // _PAGE)), _PAGE, _CAP, "cursor")
    item = F.from_json("body", "id long, n long")
    return items.select("slice", "place", item.alias("x")).groupBy("slice").agg(F.count("*").alias("n"), F.sum("x.id").alias("ids"), F.max(F.when(F.col("x.n") == F.col("place"), F.col("place"))).alias("last"))


@registry.add("SELECT replace(n_name, ' ', '_') AS slice, 37 * n_nationkey::BIGINT AS n, coalesce(sum(i), 0)::BIGINT AS checksum FROM nation, LATERAL (SELECT unnest(generate_series(0, 37 * n_nationkey - 1)) AS i) GROUP BY 1, 2")
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paged service as a data source, slices as partitions."""
    spark.dataSource.register(paged.PagedSource)
    names = [(r.n_name.replace(" ", "_"), 37 * r.n_nationkey) for r in table(spark, sf_dir, "nation").collect()]  # the list of slices to ask for
    rows = spark.read.format("paged").option("slices", ",".join(f"{a}:{n}" for a, n in names)).option("page", 100).load()
    return rows.groupBy(F.split_part("slice", F.lit(":"), F.lit(1)).alias("slice")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("body", "$.n").cast("long")).alias("checksum"))


@registry.add(
    """WITH m AS (SELECT unnest(generate_series(DATE '1999-11-01', DATE '2000-02-01', INTERVAL 1 MONTH))::DATE AS m), s AS (SELECT c AS category, c || '/' || strftime(m, '%Y-%m') AS slice, greatest(m, DATE '1999-11-24') AS b, least(last_day(m), DATE '2000-02-22') AS e FROM m, (VALUES ('F'), ('O'), ('P')) v(c))
SELECT category, slice, b AS "begin", e AS "end", count(o_orderkey) AS expected FROM s LEFT JOIN orders ON o_orderstatus = category AND o_orderdate::DATE BETWEEN b AND e WHERE NOT (category = 'F' AND slice < 'F/2000') GROUP BY ALL"""
)
def open_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and month slices of a range of days that are not done yet, with the number of records that
    each should have."""
    slices = paged.month_slices(spark, ["F", "O", "P"], "1999-11-24", "2000-02-22")
    done = slices.where("slice < 'F/2000'").select("slice", F.lit(True).alias("done"))
    left = paged.unfinished(slices, done)
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("category"), F.col("o_orderdate").cast("date").alias("day"))
    o = o.where("day BETWEEN '1999-11-24' AND '2000-02-22'").groupBy("category", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    n = o.select(F.concat_ws("/", "category", "month").alias("slice"), "n")
    return left.join(n, "slice", "left").select("category", "slice", "begin", "end", F.coalesce("n", F.lit(0)).alias("expected"))


@registry.add("SELECT count(*) AS n, 0::BIGINT AS out_of_order, count(*) FILTER (o_orderkey % 50 = 0) AS undated FROM orders")
def ordered_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written in order of date and id, no date first; the order of the files read back is checked."""
    k, path = F.col("o_orderkey"), scratch(spark, "ordered")
    o = table(spark, sf_dir, "orders").select(F.when(k % 50 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.format_string("%012d", k).alias("id"))
    jsonl.write_ordered(o, path)
    rows = spark.read.schema("date string, id string").json(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"), F.concat_ws("/", F.coalesce("date", F.lit("")), "id").alias("key"))
    inner = rows.withColumn("before", F.lag("key").over(Window.partitionBy("file").orderBy("at")))
    ends = rows.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high")).withColumn("before", F.lag("high").over(Window.orderBy("file")))  # a row a file
    wrong = inner.agg(F.count("*").alias("n"), F.count_if(F.col("before") > F.col("key")).alias("inside"), F.count_if(F.col("key").startswith("/")).alias("undated"))
    return wrong.crossJoin(ends.agg(F.count_if(F.col("before") > F.col("low")).alias("between"))).select("n", (F.col("inside") + F.col("between")).alias("out_of_order"), "undated")


_SHARES = ratio_sql(f"SELECT event_type, count(*) FILTER (w = 'trailing') AS t, count(*) FILTER (w = 'preceding') AS p FROM (SELECT *, {_W} AS w FROM events) GROUP BY 1", "event_type", "")


@registry.add(f"SELECT event_type, t, p, round(ratio, 3) AS ratio, round(ci_low, 3) AS ci_low, round(ci_high, 3) AS ci_high, label, 'two windows' AS method FROM ({_SHARES})")
def analysis_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analysis published as one JSON document, its numbers rounded, and read back."""
    t = share_table(spark, sf_dir).select("event_type", F.struct("t", "p").alias("counts"), F.array("ratio", "ci_low", "ci_high").alias("interval"), "label")
    text = P.document({"clusters": P.round_floats(t, 3)}, {"method": "two windows"})
    path = scratch(spark, "analysis")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    read = jsonl.read_json_array(spark, path, "method string, clusters array<struct<event_type: string, counts: struct<t: long, p: long>, interval: array<double>, label: string>>")
    c = read.select("method", F.explode("clusters").alias("c"))
    return c.select("c.event_type", "c.counts.t", "c.counts.p", *[F.col("c.interval")[i].alias(n) for i, n in enumerate(("ratio", "ci_low", "ci_high"))], "c.label", "method")


@registry.add("SELECT 'clusters' AS section, count(DISTINCT event_type) AS n FROM events UNION ALL SELECT 'monthly', count(DISTINCT strftime(o_orderdate, '%Y-%m')) FROM orders UNION ALL SELECT 'servers', count(DISTINCT user_id % 8) FROM events UNION ALL SELECT 'claims', count(*) FROM nation UNION ALL SELECT 'caveats', 2")
def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data of a report, put together from several analyses with static texts; rows of each section."""
    from . import merges, reviews, shares

    sections = {"clusters": share_table(spark, sf_dir), "monthly": shares.monthly_diagnostics(spark, sf_dir), "servers": merges.yield_rollup(spark, sf_dir), "claims": reviews.claim_scores(spark, sf_dir)}
    text = P.document({n: P.round_floats(d, 4) for n, d in sections.items()}, {"caveats": ["dates are those of posting", "titles are compared without accents"]})
    path = scratch(spark, "report")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    names = [*sections, "caveats"]
    read = jsonl.read_json_array(spark, path, ", ".join(f"{n} array<string>" for n in names))
    return read.select(F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.size(n).cast("long").alias("n")) for n in names])).alias("s")).select("s.*")


@registry.add(f"WITH s AS ({_SHARES}) SELECT 'console' AS form, count(*) + 1 AS lines FROM s UNION ALL SELECT 'markdown', count(*) + 2 FROM s UNION ALL SELECT 'page', count(*) + 1 FROM s UNION ALL SELECT 'registry', count(*) FROM s")
def report_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as a console table, a Markdown table and registry, and a page; the rows of each."""
    t = share_table(spark, sf_dir).select("event_type", "t", "p", "ratio", "label").orderBy("event_type")
    page = P.report_page("<html>{{title}}{{shares}}</html>", "Shares", {"shares": t})
    forms = [("console", P.console_table(t).count("\n") + 1), ("markdown", P.markdown_table(t).count("\n") + 1), ("page", page.count("<tr>")), ("registry", P.registry_markdown("Candidates", "n", t, "event_type").count("\n## "))]
    return spark.createDataFrame(forms, "form string, lines long")


@registry.add("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'crossref' WHEN 1 THEN 'zenodo' ELSE 'osti' END AS server, CASE WHEN o_orderkey % 3 = 2 THEN 'osti:' || o_orderkey::VARCHAR ELSE 'doi:10.1/' || o_orderkey::VARCHAR END AS id, CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE 'T ' || o_orderkey::VARCHAR END AS title, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS author FROM orders WHERE NOT (o_orderkey % 3 = 1 AND o_orderkey % 4 = 0)")
def source_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One projection for each source's layout, rows of a wrong kind left out."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    n, d = k.cast("string"), F.col("o_orderdate")
    title = F.when(k % 15 > 0, F.concat(F.lit("T "), n))
    crossref = F.to_json(F.struct(F.concat(F.lit("10.1/"), n).alias("DOI"), F.array(title).alias("title"), F.struct(F.array(F.array(F.year(d), F.month(d), F.dayofmonth(d))).alias("date-parts")).alias("posted"), F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("author")))
    zenodo = F.to_json(F.struct(F.struct(title.alias("title"), F.date_format(d, "yyyy-MM-dd").alias("publication_date"), F.array(F.struct(F.col("o_orderpriority").alias("name"))).alias("creators"), F.struct(F.when(k % 4 == 0, "dataset").otherwise("publication").alias("type")).alias("resource_type")).alias("metadata"), F.concat(F.lit("10.1/"), n).alias("doi")))
    osti = F.to_json(F.struct(k.alias("osti_id"), title.alias("title"), F.date_format(d, "yyyy-MM-dd'T'00:00:00").alias("publication_date"), F.array(F.concat("o_orderpriority", F.lit(" [ORCID:1]"))).alias("authors")))
    server = F.when(k % 3 == 0, "crossref").when(k % 3 == 1, "zenodo").otherwise("osti")
    rows = o.select("o_orderkey", server.alias("server"), F.when(k % 3 == 0, crossref).when(k % 3 == 1, zenodo).otherwise(osti).alias("body"))
    return P.projected(rows, "body", "server").select("o_orderkey", "server", "id", "title", "date", F.col("authors")[0].alias("author"))
