"""Merged keys, ranks, phrases, intervals, buckets, pruning, versions and limits."""

import random
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from corpusmill.functions import phrases
from corpusmill.operators import aliases, markup, ranking, records
from corpusmill.plans import flows, links
from corpusmill.sources import jsonl, paged


def pairs(spark, rows):
    return spark.createDataFrame(rows, "alias string, key string")


def test_chains_close_in_few_rounds(spark):
    chain = [(f"k{i}", f"k{i + 1}") for i in range(100)] + [("x", "k40"), ("y", "z"), ("y", "z"), (None, "q"), ("q", None)]
    got = {r.alias: (r.key, r.steps) for r in aliases.close_aliases(pairs(spark, chain)).collect()}
    assert got == {f"k{i}": ("k100", 100 - i) for i in range(100)} | {"x": ("k100", 61), "y": ("z", 1)}
    assert aliases.close_aliases(pairs(spark, [])).count() == 0


@pytest.mark.parametrize("rows, message", [([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "circle"), ([("a", "a")], "circle"), ([("a", "b"), ("b", "a")], "circle"), ([("a", "b"), ("a", "c")], "two keys")])
def test_bad_chains_raise(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        aliases.close_aliases(pairs(spark, rows))


def lanes(spark, rows):
    return spark.createDataFrame(rows, "key string, identity string, lane int, title string")


def test_lanes_merge_and_keys_follow(spark):
    refs = lanes(spark, [("a", "1", 0, "A"), ("b", "1", 1, "B"), ("b", "1", 2, "B again"), ("c", "2", 1, "C"), ("p", "9", 0, "P"), ("n", None, 0, "N"), ("m", None, 0, "M"), (None, "3", 0, "none")])
    works, closed = aliases.merge_lanes(refs, "identity", "key", ["lane"], pairs(spark, [("p", "b"), ("unused", "a")]))
    assert sorted(r.key for r in works.collect()) == ["a", "c", "m", "n"]
    assert sorted((r.alias, r.key, r.steps) for r in closed.collect()) == [("b", "a", 1), ("p", "a", 2)]
    cites = spark.createDataFrame([(1, "p"), (2, "a"), (3, None), (4, "c")], "row int, ref string")
    out = aliases.rewrite_keys(cites, "ref", closed, works, "key")
    assert sorted((r.row, r.ref) for r in out.collect()) == [(1, "a"), (2, "a"), (3, None), (4, "c")] and out.columns == ["row", "ref"]
    with pytest.raises(ValueError, match="ref names no work.*zz"):
        aliases.rewrite_keys(cites.unionByName(spark.createDataFrame([(5, "zz")], "row int, ref string")), "ref", closed, works, "key")


@pytest.mark.parametrize(
    "rows, message",
    [
        ([("a", "1", 0, ""), ("a", "2", 0, "")], "names two works"),
        ([("a", "1", 0, ""), ("b", "2", 0, ""), ("k", "1", 1, ""), ("k", "2", 1, "")], "stands for two keys"),
        ([("a", "1", 0, ""), ("b", "2", 0, ""), ("b", "1", 1, "")], "both a work's own and an alias"),
    ],
)
def test_merges_that_would_lose_a_work_raise(spark, rows, message):
    with pytest.raises(ValueError, match=message):
        aliases.merge_lanes(lanes(spark, rows), "identity", "key", ["lane"])


def test_samples_by_rank(spark):
    rng = random.Random(1)
    groups = {"a": [rng.randrange(10**6) for _ in range(3000)], None: [rng.randrange(50) for _ in range(700)], "b": [5] * 400, "c": [9], "d": list(range(3))}
    rows = [(g, i) for g, ids in groups.items() for i in ids] + [("a", None)]
    table = spark.createDataFrame(rows, "g string, id long").repartition(6)
    for k in (1, 5, 40):
        got = {(r.group, r.place): r.id for r in ranking.twister_sample(table, "g", "id", 42, k).collect()}
        assert got == {(g, p): i for g, ids in groups.items() for p, i in enumerate(random.Random(42).sample(sorted(ids), min(k, len(ids))), 1)}
        got = {(r.group, r.place): r.id for r in ranking.twister_shuffle(table, "g", "id", 7, k).collect()}
        want = {}
        for g, ids in groups.items():
            whole = sorted(ids)
            random.Random(7).shuffle(whole)
            want |= {(g, p): i for p, i in enumerate(whole[:k], 1)}
        assert got == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows become one partition
    ranks = ranking.Ranks(table, "g", "id")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r.n for r in ranks.rows.groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert len(parts) == 4 and max(parts) < 0.5 * sum(parts)  # no task has a group, nor all rows of one id
    assert ranking.twister_sample(table.limit(0), "g", "id", 1, 3).count() == 0


def test_phrases_equal_a_pattern_each(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    known = sorted({" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(3000)})
    texts = [" ".join(word() + rng.choice(["", "", ",", "é", "-x"]) for _ in range(rng.randrange(0, 30))) for _ in range(60)] + ["", " ", "a  b"]
    machine = phrases.Phrases(known)
    patterns = [re.compile(r"(?<![a-z0-9])" + r"\s?".join(map(re.escape, p.split()))) for p in known]
    for t in texts:
        t = " ".join(t.split())
        assert machine.found(t) == [i for i, p in enumerate(patterns) if p.search(t)], t
    table = spark.createDataFrame([(1, "red cat sat"), (2, "redcat"), (3, None), (4, "re dcat"), (5, "infrared cat")], "id int, t string")
    few = spark.createDataFrame([("red cat",), ("red cat",), ("",), (None,), ("cat",)], "phrase string")
    for most in (1, 1 << 20):  # several automata or one
        assert sorted((r.id, r.phrase) for r in phrases.phrase_hits(table, few, "t", "phrase", most).collect()) == [(1, "cat"), (1, "red cat"), (2, "red cat"), (5, "cat")]
    assert phrases.phrase_hits(table, few.limit(0), "t", "phrase").count() == 0


def test_chains_of_selectors(spark):
    page = "<div id=a class='x y'><p>1<span class=x>2</span></p><div class=x><p class=x>3</p></div></div><p>4</p><br>"
    nodes = markup.html_nodes(spark.createDataFrame([(1, page), (2, page), (3, None)], "page_id long, html string"))
    ids = lambda chain: sorted(r.node_id for r in markup.select(nodes, chain).where("page_id = 2").collect())
    assert ids("div p") == [1, 4] and ids("div > p") == [1, 4] and ids("#a > p") == [1] and ids(".x .x") == [2, 3, 4]
    assert ids("div div > .x") == [4] and ids("p span") == [2] and ids("div.x.y *") == [1, 2, 3, 4] and ids("p > div") == []
    whole = {r.node_id: r.whole for r in markup.text_of(nodes).where("page_id = 1").collect()}
    assert whole == {0: "1 2 3", 1: "1 2", 2: "2", 3: "3", 4: "3", 5: "4"}
    deep = markup.html_nodes(spark.createDataFrame([(1, "<div>" * 3000 + "x")], "page_id long, html string"))
    assert markup.inside(deep, deep).count() == 2999 and markup.text_of(deep, deep.where("node_id = 0")).first().whole == "x"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_buckets_join_without_an_exchange(spark):
    joined = links.bucketed_join(spark, SF)
    physical = plan(joined).split("== Physical Plan ==")[1]
    assert "Exchange" not in physical and "SortMergeJoin" in physical and "Bucketed: true" in physical


def test_scans_are_pruned(spark):
    scan = flows.partition_pruned_scan(spark, SF)
    assert "PartitionFilters: [isnotnull(region" in plan(scan) and "GreaterThanOrEqual(year,1996)" in plan(scan)
    assert "dynamicpruning" in plan(flows.dynamic_pruned_scan(spark, SF)).lower()
    labels = flows._label_table(spark, SF)
    assert len(labels.where("region = 2 AND status = 'P'").select("year").inputFiles()) >= 1
    files = lambda df: df._jdf.queryExecution().executedPlan()
    read = labels.where("region = 2 AND status = 'P'").select("o_orderkey", F.input_file_name().alias("f"))
    assert {re.search(r"region=(\d)/status=(\w)", r.f).groups() for r in read.collect()} == {("2", "P")} and files(read) is not None


def test_variants_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "[1, 2"), (4, '{"a": null}'), (5, '{"a": "7"}'), (6, '{"a": 7}'), (7, '{"a": {"b": 1}}'), (8, "3"), (9, '{"a": 99999999999999999999}')]
    df = spark.createDataFrame(rows, "id int, j string")
    got = {r.id: (r.parsed, r.loose, r.wrong_loose, r.strict, r.wrong_strict) for r in records.variant_fields(df, "j", {"loose": ("$.a", "bigint", False), "strict": ("$.a", "bigint", True)}).collect()}
    none = (None, False, None, False)
    assert got == {1: (False, *none), 2: (False, *none), 3: (False, *none), 4: (True, *none), 5: (True, 7, False, None, True), 6: (True, 7, False, 7, False), 7: (True, None, True, None, True), 8: (True, *none), 9: (True, None, True, None, True)}


def test_publication_is_whole_or_not_at_all(spark, tmp_path):
    folder = f"file://{tmp_path}/set"
    rows = lambda *names: spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file string, id int")
    with pytest.raises(FileNotFoundError):
        jsonl.published(spark, folder)
    assert jsonl.publish(rows("a", "b", "c"), folder, "file") == 3
    first = jsonl.published(spark, folder)
    read = lambda at: sorted(r.id for r in spark.read.schema("id int").json(f"{at}/*.jsonl").collect())
    assert read(first) == [0, 1, 2]
    broken = rows("a", "b").withColumn("id", F.when(F.col("id") == 1, F.raise_error(F.lit("lost")).cast("int")).otherwise(7))
    with pytest.raises(Exception, match="lost"):
        jsonl.publish(broken, folder, "file")
    assert jsonl.published(spark, folder) == first and read(first) == [0, 1, 2]
    assert jsonl.publish(rows("z"), folder, "file") == 1
    second = jsonl.published(spark, folder)
    assert read(second) == [0] and read(first) == [0, 1, 2]  # a reader of the old version is not disturbed
    jsonl.publish(rows("y"), folder, "file")
    assert jsonl.drop_versions(spark, folder) == 1 and read(jsonl.published(spark, folder)) == [0]


def test_nothing_is_cut_in_silence(spark):
    many = spark.range(10_500)
    for make in (lambda: records.document({"s": many}), lambda: records.markdown_table(many), lambda: records.registry_markdown("t", "n", many, "id"), lambda: records.console_table(many), lambda: records.report_page("{{t}}", "t", {"t": many})):
        with pytest.raises(ValueError, match="too many for one report"):
            make()
    assert records.document({"s": spark.range(3)}).count('"id"') == 3
    left = paged.id_batches(spark.range(30), spark.range(5), "id", 2, 3).collect()
    assert len(left) == 3 and {r.left_over for r in left} == {19}


def test_scan_goes_on_where_it_ended(spark, tmp_path):
    from corpusmill.streaming import events as S

    pages, target, held = (f"file://{tmp_path}/{x}" for x in ("pages", "scanned", "state"))
    write = lambda a, b: spark.range(a, b).select(F.col("id").alias("n"), (F.col("id") % 2).alias("s")).repartition(20).write.mode("append").partitionBy("s").json(pages)
    run = lambda **kw: S.resume_pages(spark, pages, "n long", target, held, files_a_trigger=2, **kw)
    read = lambda: sorted(r.n for r in spark.read.parquet(target).select("n").collect())
    write(0, 50)
    assert run(batches=1) >= 1
    part = read()
    assert 0 < len(part) < 50
    # A batch that fails leaves nothing behind, and is run again once the page is mended.
    bad = tmp_path / "pages" / "s=0" / "part-zz.json"
    bad.write_text('{"n": 50}\n{"n": "x\n')
    with pytest.raises(Exception):
        run()
    seen = read()
    assert set(part) <= set(seen) and len(seen) == len(set(seen))
    bad.write_text('{"n": 50}\n')
    run()
    assert read() == list(range(51))
    write(51, 80)
    run()
    assert run(batches=1) == 0  # nothing is left
    assert read() == list(range(80))


def test_sequence_join_equals_all_pairs(spark):
    from corpusmill.functions import evidence as E
    from corpusmill.operators import sequences

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6)))
    base = [" ".join(word() for _ in range(rng.randrange(1, 14))) for _ in range(40)]
    rows = list(base)
    for t in base:
        for _ in range(3):
            c = list(t)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(c))
                rng.choice([lambda: c.insert(i, rng.choice("abc ")), lambda: c.pop(i) if len(c) > 1 else None, lambda: c.__setitem__(i, "z")])()
            rows.append("".join(c).upper())
        rows.append(" ".join(t.split()[: rng.randrange(1, 9)]) + "!")
    rows += ["", None, "...", "a", "a", "ab", "x" * 300, "x" * 290 + "y" * 10, "é è", "É-È"]
    table = spark.createDataFrame(list(enumerate(rows)), "id long, t string").repartition(3)
    first = {}
    form = lambda t: re.sub(r"[\W_]+", " ", t or "").strip().lower()
    for i, t in enumerate(rows):
        if form(t):
            first.setdefault(form(t), i)
    for others in (False, True):
        got = sorted((r["query"], r["match"]) for r in sequences.sequence_matches(table, table, "id", "t", others).collect())
        want = sorted((i, j) for i, t in enumerate(rows) for f, j in first.items() if E.same_title(form(t), f) and not (others and form(t) == f))
        assert got == want and len(want) > 100
    # Bounds by length and characters leave what difflib says as it is.
    import difflib

    for a in rows[:60]:
        for b in rows[:60]:
            x, y = form(a), form(b)
            if x and y and not (min(len(x.split()), len(y.split())) >= 5 and (x + " ").startswith(y + " ") | (y + " ").startswith(x + " ")):
                assert E.same_title(a, b) == (difflib.SequenceMatcher(None, x, y).ratio() >= 0.92)


def test_formula_verdicts():
    from corpusmill.functions import evidence as E

    text = "La3Ni2O7-δ on SiO2, CuO2 planes, BICs of CP1; Zz2O3, Nd123O, HO, MnMn2, (SrO2) and Sr(BO3)2, NiAs-type MnTe, H2O-x"
    assert E.candidates(text) == [("La3Ni2O7", "formula"), ("SiO2", "generic"), ("CuO2", "unit"), ("BICs", "plural"), ("CP1", "acronym"), ("Zz2O3", "element"), ("Nd123O", "count"), ("HO", "letters"), ("MnMn2", "single"), ("SrO2", "context"), ("BO3", "context"), ("NiAs", "context"), ("MnTe", "formula"), ("H2O", "generic")]
    assert E.candidates(None) == [] and E.formulas_in("MnTe and MnTe") == ["MnTe"]


def test_least_ids_of_terms(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(40), [rng.choice("abcdé") for _ in range(rng.randrange(0, 4))] if rng.random() < 0.9 else None) for _ in range(300)]
    rows += [("x", None, ["a"]), ("z", 1, [])]
    table = spark.createDataFrame(rows, "grp string, id long, terms array<string>").repartition(5)
    got = {(r.grp, r.term): (r.n, r.ids) for r in ranking.least_per_term(table, 3).collect()}
    want = {}
    for g, i, terms in rows:
        for t in terms or [] if i is not None else []:
            want.setdefault((g, t), []).append(i)
    assert got == {key: (len(ids), sorted(set(ids))[:3]) for key, ids in want.items()}
    assert ranking.least_per_term(table.limit(0), 3).count() == 0


def test_long_titles_of_few_syllables_do_not_all_meet(spark):
    from corpusmill.functions import evidence as E
    from corpusmill.operators import sequences

    rng = random.Random(9)
    parts = ["th", "er", "and", "of", "tion", "en", "re", "ly", "st", " ", " ", " ", "wh", "b"]
    base = ["".join(rng.choice(parts) for _ in range(rng.choice((40, 90, 130, 220)))) for _ in range(90)]
    rows = list(base)
    for t in base[:45]:
        c = list(t)
        for _ in range(rng.randrange(1, 30)):
            i = rng.randrange(len(c))
            rng.choice([lambda: c.insert(i, rng.choice("qxe ")), lambda: c.pop(i), lambda: c.__setitem__(i, "z")])()
        rows += ["".join(c), t[: rng.randrange(len(t) // 2, len(t))]]
    form = list(dict.fromkeys(E.plain_title(t) for t in rows))
    table = spark.createDataFrame(list(enumerate(form)), "id long, t string").repartition(3)
    got = sorted((r["query"], r["match"]) for r in sequences.sequence_matches(table, table, "id", "t", others=True).collect())
    want = sorted((i, j) for i, a in enumerate(form) for j, b in enumerate(form) if i != j and E.same_title(a, b))
    assert got == want and len(want) > 60
    # Nearly all pairs share their rare grams; few have counts that allow the ratio.
    texts = spark.createDataFrame(list(enumerate(form)), "key long, norm string")
    assert sequences._near(texts).count() < 2 * len(want)


def test_bits_of_two_titles_differ_in_as_many_words_at_most(spark):
    from corpusmill.operators import simjoin

    rng = random.Random(3)
    sets = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(rng.randrange(0, 90))] for _ in range(30)]
    sets += [s[:-3] + [1, 2] for s in sets[:10] if len(s) > 3]
    table = spark.createDataFrame(list(enumerate(sets)), "i int, own array<long>")
    got = table.select("i", *[simjoin.set_bits(F.col("own"), i, 3).alias(f"b{i}") for i in range(3)]).orderBy("i").collect()
    bits = [[x & (1 << 64) - 1 for x in row[1:]] for row in got]
    assert all(sum(map(int.bit_count, row)) <= len(set(s)) and (not s or any(row)) for row, s in zip(bits, sets))
    assert all(sum((x ^ y).bit_count() for x, y in zip(bits[i], bits[j])) <= len(set(a) ^ set(b)) for i, a in enumerate(sets) for j, b in enumerate(sets))


def test_terms_are_counted_in_stretches_of_bounded_size(spark, monkeypatch):
    import pyarrow as pa

    from corpusmill.operators import ranking

    batch = pa.RecordBatch.from_pydict({"grp": ["a", None, "b", "a"] * 5, "id": list(range(20)), "terms": [[f"t{j}" for j in range(i)] if i % 7 else None for i in range(20)]})
    monkeypatch.setattr(ranking, "TERMS", 16)
    parts = list(ranking._slices(batch))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(len(p) == 1 or sum(len(t or ()) for t in p.column("terms").to_pylist()) <= 16 for p in parts) and len(parts) > 8
    whole = ranking._least_of_batch(batch, 3).to_pylist()
    assert {(r["grp"], r["term"]): (r["n"], r["ids"]) for r in whole}[(None, "t0")] == (5 - 0, [1, 5, 9])


def test_joins_by_page_send_nothing_through_the_driver(spark):
    nodes = markup.html_nodes(spark.createDataFrame([(1, '<section id="references"><ol class="references"><li id="ref-1"><span class="ref-title">T</span><a href="x">l</a></li></ol></section>')], "page_id long, html string"))
    items = markup.reference_items(nodes)
    found = items.join(markup.item_links(nodes, items).hint("merge"), ["page_id", "node_id"], "left")
    assert found.select("title", "links").collect() == [("T", ["x"])]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_sets_are_ordered_alike_whatever_the_sample(spark):
    import numpy as np

    from corpusmill.operators import simjoin

    table = spark.createDataFrame([(1, [5, -7, 9]), (2, [9, 5]), (3, [9]), (4, [])], "id long, set array<long>")
    order = simjoin.frequent_tokens(table, "id")
    assert [x.tolist() for x in order] == [[5, 9], [2, 3]]
    for known in (order, (np.zeros(0, np.int64), np.zeros(0, np.int64))):
        got = [r[0] for r in table.select("id", simjoin.rarest_first(F.col("set"), known).alias("s")).orderBy("id").select("s").collect()]
        assert got == ([[-7, 5, 9], [5, 9], [9], []])
