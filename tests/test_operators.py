import json
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.operators import dedup, markup, ranking, simjoin
from corpusmill.sources import jsonl, paged


def test_html(spark):
    html = "<html><body><div id='a' class='x y'><p>One <b>two</b></p><br/></div><p>three</p></body></html>"
    nodes = markup.html_nodes(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    rows = {r.node_id: r for r in nodes.collect()}
    assert [rows[i].tag for i in range(len(rows))] == ["html", "body", "div", "p", "b", "br", "p"]
    assert rows[2].classes == ["x", "y"] and rows[2].elem_id == "a" and (rows[4].depth, rows[2].last_id, rows[0].last_id) == (4, 5, 6)
    inner = markup.inside(nodes, nodes.where("elem_id = 'a'"))
    assert sorted(r.node_id for r in inner.collect()) == [3, 4, 5]
    whole = {r.node_id: r.whole for r in markup.text_of(nodes).collect()}
    assert whole[2] == "One two" and whole[1] == "One two three"


def test_markdown(spark):
    df = spark.createDataFrame([("## A\n| h |\n|---|\n| *1* | [t](u) |\n## B\nx",)], "t string")
    r = df.select(F.size(markup.sections(F.col("t"))).alias("n"), markup.table_rows(F.col("t")).alias("rows"), markup.strip_markdown(F.col("t")).alias("plain")).first()
    assert r.n == 2 and r.rows == [["h"], ["*1*", "[t](u)"]] and "t" in r.plain and "(u)" not in r.plain


def test_twister_sample(spark):
    df = spark.createDataFrame([("g", i) for i in range(50)], "g string, id long")
    got = [r.id for r in ranking.twister_sample(df, "g", "id", 42, 15).orderBy("place").collect()]
    assert got == random.Random(42).sample(list(range(50)), 15)


def test_twister_shuffle(spark):
    df = spark.createDataFrame([("g", i) for i in range(50)], "g string, id long")
    want = list(range(50))
    random.Random(7).shuffle(want)
    assert [r.id for r in ranking.twister_shuffle(df, "g", "id", 7, 5).orderBy("place").collect()] == want[:5]


def test_greedy(spark):
    """Against the sequential choice, with many terms that share one id."""
    rng = random.Random(4)
    rows = [("g", 3.0, f"t{i:02d}", 1) for i in range(13)] + [("g", 2.0, "u", 1), ("g", 2.0, "u", 2), ("g", 1.0, "v", 3)]
    for g in "abcdef":
        rows += list({(g, float(rng.randint(1, 4)), f"t{rng.randint(0, 6)}", rng.randint(1, 5)) for _ in range(rng.randint(1, 25))})
    scores = {}
    rows = [(g, scores.setdefault((g, t), s), t, i) for g, s, t, i in rows]  # one score a term
    pool = [(g, i) for g in "gabcdef" for i in range(3, 9)]
    want = set()
    for g in "gabcdef":
        used, place = set(), 0
        for _, t in sorted({(s, t) for gg, s, t, _ in rows if gg == g}, reverse=True):
            free = sorted({i for gg, _, tt, i in rows if (gg, tt) == (g, t)} - used)
            if free and place < 3:
                place += 1
                used.add(free[0])
                want.add((g, place, t, free[0]))
        for i in sorted(i for gg, i in pool if gg == g):
            if place < 3 and i not in used:
                place += 1
                used.add(i)
                want.add((g, place, None, i))
    df = spark.createDataFrame(rows, "grp string, score double, term string, id long")
    got = ranking.greedy_exemplars(df, 3, spark.createDataFrame(pool, "grp string, id long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_edits(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "k int, f string")
    edits = spark.createDataFrame([(1, "a", "A"), (2, "b", "B"), (3, "x", "C")], "k int, old string, new string")
    assert sorted((r.k, r.f, r.edited) for r in dedup.apply_edits(rows, edits, "k", "f").collect()) == [(1, "A", True), (2, "b", False), (2, "b", False), (3, "c", False)]


def test_keep_first_and_merge(spark):
    df = spark.createDataFrame([("k", 2, "x"), ("k", 1, "y"), (None, 1, "z")], "k string, o int, v string")
    assert sorted(r.v for r in dedup.keep_first(df, ["k"], ["o"]).collect()) == ["y", "z"]
    lanes = spark.createDataFrame([("i", "a", 2), ("i", "b", 1), ("j", "c", 1)], "identity string, key string, lane int")
    named, aliases = dedup.merge_identities(lanes, "identity", "key", "lane")
    assert [(r.alias, r.canonical) for r in aliases.collect()] == [("a", "b")]


def test_near_matches(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = [sorted(rng.sample(words, rng.randint(4, 9))) for _ in range(60)]
    texts += [sorted({*t[1:], rng.choice(words)}) for t in texts[:30]]
    df = spark.createDataFrame([(i, " ".join(t), t) for i, t in enumerate(texts)], "id long, norm string, tokens array<string>")
    got = {(r["query"]): (r["match"], r["how"]) for r in simjoin.best_matches(df, "id", "norm", "tokens", 0.6).where("how = 'near'").collect()}
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(" ".join(t), i)
    reps = sorted(first.values())
    want = {}
    for a in reps:
        scored = [(len(set(texts[a]) & set(texts[b])) / len(set(texts[a]) | set(texts[b])), -b) for b in reps if a != b]
        j, b = max(scored)
        if j >= 0.6 and len(set(texts[a])) >= 4:
            want[a] = (-b, "near")
    assert got == want


def near_copies(rng, groups, sizes, share=0.06):
    """(id, tokens): groups of near copies of random token sets, each with some of its tokens replaced."""
    rows, fresh = [], iter(range(10**9))
    for _ in range(groups):
        base = [f"w{next(fresh)}" for _ in range(rng.choice(sizes))]
        for _ in range(rng.randint(1, 9)):
            rows.append((len(rows), [t if rng.random() > share else f"w{next(fresh)}" for t in base] + [f"c{rng.randrange(40)}" for _ in range(3)]))
    return rows


def best_of(query, index, threshold=0.8):
    """id: (match, jaccard) by brute force, of the rows of other ids."""
    best = {}
    for i, t in query:
        held = [(-len(set(t) & set(u)) / len(set(t) | set(u)), j) for j, u in index if i != j]
        j, match = min(held)
        if -j >= threshold and len(set(t)) >= 4:
            best[i] = (match, round(-j, 9))
    return best


def test_pairs_are_compared_in_cells(spark, monkeypatch):
    """Against brute force with sets of 1 to 900 tokens, by whole homes and by many small blocks; two tables with ids in
    common."""
    rng = random.Random(11)
    rows = near_copies(rng, 30, [1, 2, 4, 9, 30, 63, 64, 65, 130, 900])
    other = [(i, t[:-1] + ["y"]) for i, t in rng.sample(rows, 40)] + near_copies(rng, 3, [20])[:5]
    other = list({i: (i, t) for i, t in other}.values())
    frame = lambda x: spark.createDataFrame([(i, " ".join(t), t) for i, t in x], "id long, norm string, tokens array<string>")
    found = lambda df: {r["query"]: (r["match"], round(r["jaccard"], 9)) for r in df.where("how = 'near'").collect()}
    want, across = best_of(rows, rows), best_of(other, rows)
    assert len(want) > 30 and len(across) > 10
    for block, least in ((1 << 20, 512), (128, 1)):
        monkeypatch.setattr(simjoin, "BLOCK", block)
        monkeypatch.setattr(simjoin, "LEAST", least)
        assert found(simjoin.best_matches(frame(rows), "id", "norm", "tokens")) == want
    assert found(simjoin.index_matches(frame(rows), frame(other), "id", "norm", "tokens")) == across


def test_near_copies_move_once(spark):
    """The shuffle grows with the sets, not with the pairs: of near copies, and of large sets that share rare words alone."""

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        time.sleep(0.5)
        seen = sc.statusStore().executorList(False)
        return sum(seen.apply(i).totalShuffleWrite() for i in range(seen.size()))

    rng = random.Random(5)
    base = [f"b{i}" for i in range(2000)]
    rows = [(i, [t if rng.random() > 0.02 else f"x{i}-{k}" for k, t in enumerate(base)]) for i in range(60)]
    rows += [(100 + i, [f"r{k}" for k in range(300)] + [f"u{i}-{k}" for k in range(1700)]) for i in range(60)]
    frame = spark.createDataFrame([(i, " ".join(t), t) for i, t in rows], "id long, norm string, tokens array<string>").repartition(4).localCheckpoint()
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")
    try:
        before = written()
        got = {r["query"]: (r["match"], round(r["jaccard"], 9)) for r in simjoin.best_matches(frame, "id", "norm", "tokens").collect()}
        moved = written() - before
    finally:
        spark.conf.unset(limit)
    assert got == best_of(rows, rows) and set(got) == set(range(60))
    assert moved < 6 * 8 * sum(len(t) for _, t in rows), moved


def test_jsonl(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    good = {"id": "1", "server": None, "window": "trailing", "date": "2025-01-02", "title": "t"}
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(good), "", "{bad", json.dumps(good | {"id": "2", "window": None})]))
    (tmp_path / "raw" / "b.jsonl").write_text(json.dumps(good))
    assert jsonl.read_corpus(spark, str(tmp_path)).count() == 2
    kept = jsonl.read_corpus(spark, str(tmp_path), keep_bad=True).cache()
    assert kept.where("bad IS NOT NULL").count() == 1
    assert [(r.server, r.id) for r in jsonl.windowed(jsonl.read_corpus(spark, str(tmp_path))).collect()] == [("a", "1")]
    out = str(tmp_path / "out")
    jsonl.write_ordered(jsonl.read_corpus(spark, str(tmp_path)).select("date", "id"), out)
    assert spark.read.json(out).count() == 2
    spark.createDataFrame([("1",)], "id string").write.parquet(str(tmp_path / "known"))
    assert jsonl.append_new(spark.createDataFrame([("1",), ("2",), ("2",)], "id string"), str(tmp_path / "known"), "id") == 1


def test_atom(spark, tmp_path):
    (tmp_path / "p.xml").write_text("<feed><entry><id>x1</id><title>A\n  b</title><summary>s</summary><published>2025-01-02T00:00:00Z</published><author><name>Ann</name></author><author><name>Bo</name></author></entry><entry><id>err</id><title>Error</title></entry></feed>")
    rows = jsonl.read_atom(spark, str(tmp_path / "p.xml")).collect()
    assert [(r.id, r.title, r.date, r.authors) for r in rows] == [("x1", "A b", "2025-01-02", ["Ann", "Bo"])]


def test_paged_source(spark):
    spark.dataSource.register(paged.PagedSource)
    read = spark.read.format("paged").option("slices", "a:5,b:2,none,c:0")
    assert sorted(r.id for r in read.load().collect()) == ["a-0", "a-1", "a-2", "a-3", "a-4", "b-0", "b-1"]
    assert read.option("cap", 3).load().count() == 5


class Clock:
    def __init__(self):
        self.now, self.waits = 0.0, []

    def sleep(self, seconds):
        self.waits.append(seconds)
        self.now += seconds


def polite(clock, **kw):
    return paged.Politeness(sleep=clock.sleep, clock=lambda: clock.now, **kw)


def test_paging_styles():
    items = [{"id": i} for i in range(23)]
    asked = []

    def service(style):
        def fetch(_, at):
            asked.append(at)
            begin = {"offset": lambda: at, "number": lambda: (at - 1) * 5, "cursor": lambda: 0 if at == "*" else int(at[1:])}[style]()
            return {"total": 23, "items": items[begin : begin + 5], "next": f"c{begin + 5}"}

        return fetch

    for style in ("offset", "number", "cursor"):
        assert [x["id"] for x in paged.fetch_all(service(style), "s", 5, style=style)] == list(range(23))
        assert [x["id"] for x in paged.fetch_all(service(style), "s", 5, cap=12, style=style)] == list(range(12))
    assert asked[:5] == [0, 5, 10, 15, 20] and asked[8:10] == [1, 2]
    assert list(paged.fetch_all(lambda *_: None, "s", 5)) == []
    assert paged.count_only(lambda *_: {"total": 7, "items": []}, "s") == 7 and paged.count_only(lambda *_: None, "s") == 0
    for items_ in ([], [{"id": 1}]):
        try:
            list(paged.fetch_all(lambda *_, x=items_: {"total": 3, "items": x}, "s", 10))
            raise AssertionError("a short page must fail")
        except ValueError:
            pass


def test_retries_and_gaps():
    clock = Clock()
    calls = iter([OSError(), paged.TransientError(503), paged.TransientError(429, after=500), {"total": 1, "items": [{"id": 1}]}])

    def flaky(*_):
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert len(list(paged.fetch_all(flaky, "s", 10, polite=polite(clock, gap=3.0)))) == 1
    assert [w for w in clock.waits if w] == [2.0, 1.0, 4.0, 60.0]  # a wait after each failure, and what is missing to the gap
    try:
        list(paged.fetch_all(lambda *_: (_ for _ in ()).throw(OSError()), "s", 10, polite=polite(Clock())))
        raise AssertionError("the last failure must be raised")
    except OSError:
        pass
    assert paged.checked_status(200) and not paged.checked_status(404)
    for status, kind in ((429, paged.TransientError), (502, paged.TransientError), (400, ValueError)):
        try:
            paged.checked_status(status)
            raise AssertionError(status)
        except kind:
            pass


def test_recorded_pages(spark):
    rows = [("a", 0, "*", "x", 5, ["0", "1"]), ("a", 2, "x", "y", 5, ["2", "3"]), ("a", 4, "y", None, 5, ["4"]), ("b", 0, "*", None, 3, ["0"])]
    pages = spark.createDataFrame(rows, paged.RECORDED)
    assert [(r.slice, r.position, r.held, r.due) for r in paged.page_problems(pages, 2).orderBy("slice", "position").collect()] == [("b", 0, 1, 2), ("b", 2, None, None)]
    log = {r.slice: (r.fetched, r.truncated, r.done) for r in paged.slice_log(pages, 4).collect()}
    assert log == {"a": (4, True, True), "b": (1, False, False)}
    items = paged.page_items(paged.ordered_by_cursor(pages, 3), 2, None, "cursor").where("slice = 'a'").orderBy("place").collect()
    assert [(r.place, r.body) for r in items] == [(i, str(i)) for i in range(5)]
    assert [r.slice for r in paged.unfinished(pages.select("slice").distinct(), paged.slice_log(pages)).collect()] == ["b"]
    again = spark.createDataFrame([*rows, ("b", 0, "*", None, 3, ["0", "1"])], paged.RECORDED)
    assert paged.keep_latest_pages(again).where("slice = 'b'").first()["items"] == ["0", "1"]
    months = paged.month_slices(spark, ["c"], "2024-01-20", "2024-03-05").orderBy("slice").collect()
    assert [(r.slice, str(r.begin), str(r.end)) for r in months] == [("c/2024-01", "2024-01-20", "2024-01-31"), ("c/2024-02", "2024-02-01", "2024-02-29"), ("c/2024-03", "2024-03-01", "2024-03-05")]


def test_requests_by_id(spark):
    asked = []

    def fetch(ids, _):
        asked.append(ids)
        return None if ids == "3" else {"total": 1, "items": [{"id": x} for x in ids.split(",") if x != "3"]}

    assert [x["id"] for x in paged.fetch_ids(fetch, [[1, 2], [3, 4], [5]])] == ["1", "2", "4", "5"]
    assert asked == ["1,2", "3,4", "3", "4", "5"]


def test_title_search(spark):
    frame = lambda rows: spark.createDataFrame([(i, t.split()) for i, t in rows], "id long, tokens array<string>")
    index = frame([(1, "red cat on mat"), (2, "red dog"), (3, "blue whale song"), (4, "red cat")])
    got = simjoin.title_search(frame([(11, "red cat"), (12, "whale"), (13, "none")]), index, "id", "tokens", 2, 0.3).orderBy("query", "rank").collect()
    assert [(r["query"], r["match"], r.shared) for r in got] == [(11, 4, 2), (11, 1, 2), (12, 3, 1)]
    # Words that all titles have are words like any other.
    every = frame([(i, f"of the red {c}") for i, c in enumerate("abcd")])
    got = simjoin.title_search(frame([(9, "of the red")]), every, "id", "tokens", 4, 0.5).collect()
    assert sorted((r["match"], r["rank"]) for r in got) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_resolve(spark):
    from corpusmill.operators import records

    refs = spark.createDataFrame([("doi", 1, "A b"), ("doi", 2, "C"), ("doi", 3, "D"), ("url", 4, "x")], "kind string, id long, title string")
    table = lambda *rows: spark.createDataFrame(rows, "id long, found_title string, status int")
    found = records.resolve(refs, {"doi": [table((1, "a B.", 200), (2, "z", 500)), table((2, "other", 302), (1, "no", 200))], "url": [table((4, None, 404))]})
    assert sorted((r.id, r.place, r.verdict) for r in found.collect()) == [(1, 1, "ok"), (2, 2, "title"), (3, None, "missing"), (4, None, "missing")]


def test_json_array_is_checked(spark, tmp_path):
    import pytest

    (tmp_path / "a.json").write_text('[\n {"k": 1},\n {"k": 2}\n]')
    (tmp_path / "b.json").write_text('[{"k": "x"}]')
    assert sorted(r.k for r in jsonl.read_json_array(spark, str(tmp_path / "a.json"), "k int").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed|parse|convert|FAILED_READ_FILE"):
        jsonl.read_json_array(spark, str(tmp_path / "b.json"), "k int").collect()


def test_versions(spark):
    rows = [("a", None, "2024-02-01", "", ["x"]), ("a", 2, "2024-01-01", "second", ["y", "x"]), ("b", None, "", "only", []), ("c", 3, "2024-05-01", "third", ["z"]), ("c", 2, None, "two", ["z", "w"])]
    df = spark.createDataFrame(rows, "base string, version int, date string, title string, terms array<string>")
    got = {r.base: r for r in dedup.collapse_versions(df, "base", "version", "date", ("title",), ("terms",)).collect()}
    assert (got["a"].version, got["a"].title, got["a"].date, got["a"].terms, got["a"].versions) == (1, "second", "2024-01-01", ["y", "x"], [1, 2])
    assert (got["b"].version, got["b"].title, got["b"].date, got["b"].terms) == (None, "only", None, [])
    assert (got["c"].version, got["c"].title, got["c"].date, got["c"].terms) == (3, "third", "2024-05-01", ["z", "w"])
    named = spark.createDataFrame([("a", 2, "-"), ("b", 3, "/"), ("c", 1, "-"), ("d", None, None)], "base string, version int, sep string")
    works = spark.createDataFrame([("a", "bare"), ("bv1", "none"), ("b/v1", "first"), ("cv1", "x")], "id string, title string")
    assert sorted((r.base, r.id, r.title) for r in dedup.fetched_first_versions(named, works, "base", "version", "sep", "id").collect()) == [("a", "a", "bare"), ("b", "b/v1", "first")]


def test_index_matches(spark):
    index = [(1, "alpha beta gamma delta epsilon"), (2, "one two three four"), (3, "alpha beta gamma delta epsilon"), (4, "")]
    asked = [(11, "alpha beta gamma delta epsilon"), (12, "alpha beta gamma delta epsilon zeta"), (13, "one two three"), (14, ""), (15, "none of these words here")]
    frame = lambda rows: spark.createDataFrame([(i, t, t.split()) for i, t in rows], "id long, norm string, tokens array<string>")
    got = {r["query"]: (r["match"], r["how"], round(r["jaccard"], 3)) for r in simjoin.index_matches(frame(index), frame(asked), "id", "norm", "tokens").collect()}
    assert got == {11: (1, "exact", 1.0), 12: (1, "near", 0.833)}


def test_contained(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    queries = [(i, rng.choices(words, k=rng.randint(0, 25))) for i in range(60)]
    items = [(i, rng.sample(words[:20], rng.randint(1, 6))) for i in range(25)]
    q, x = spark.createDataFrame(queries, "id long, t array<string>"), spark.createDataFrame(items, "item long, t array<string>")
    for threshold in (0.5, 0.8, 1.0):
        want = {(i, j): len(set(a) & set(b)) / len(set(b)) for i, a in queries for j, b in items if len(set(a) & set(b)) >= threshold * len(set(b))}
        got = {(r.id, r["item"]): r.share for r in simjoin.contained(q, x, "id", "item", "t", threshold).collect()}
        assert got == want


def test_reports(spark):
    from corpusmill.operators import records

    df = spark.createDataFrame([("a|b", 1, 0.12345, [1.23456], {"k": 2.34567})], "name string, n int, x double, l array<double>, m map<string,double>")
    r = records.round_floats(df, 2).first()
    assert (r.name, r.n, r.x, r.l, r.m) == ("a|b", 1, 0.12, [1.23], {"k": 2.35})
    small = df.select("name", "n", "x")
    assert records.markdown_table(small).split("\n")[2] == "| a\\|b | 1 | 0.12345 |"
    assert records.console_table(small).split("\n") == ["name  n      x", "a|b   1  0.123"]
    assert "## a|b\n- n: 1\n- x: 0.12345" in records.registry_markdown("T", "n", small, "name")
    assert json.loads(records.document({"t": small}, {"note": "x"})) == {"note": "x", "t": [{"name": "a|b", "n": 1, "x": 0.12345}]}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert isinstance(e.entry(spark).toPandas(), pd.DataFrame)


def test_report_page(spark):
    from corpusmill.operators import records

    page = records.report_page("<h1>{{title}}</h1>{{t}}", "A & b", {"t": spark.createDataFrame([("<x>", 1)], "a string, b int")})
    assert page == "<h1>A &amp; b</h1><table><tr><th>a</th><th>b</th></tr><tr><td>&lt;x&gt;</td><td>1</td></tr></table>"
