"""Each contract query against a brute-force version, then the awkward tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows_of

from corpusmill.llm import jaccard, language, mixing, packing, quality, queries, sketch, store, substrings, tokencount, topk
from corpusmill.llm.encode import Encoder, tokenizer_path
from corpusmill.llm.shared import new_path, staged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum " * 30000
EDGE = [(1, None, "en", "a", 7), (2, "", "en", "a", 7), (3, " \n\t ", None, None, 7), (4, "one two three", "en", "b", 7), (4, "one two three", "en", "b", 7), (None, "null id text here", "fr", "b", 7), (5, LONG, "en", None, 7), (6, "....", "en", "a", None), (7, "été <|endoftext|> ퟿ 中文  x", "fr", "a", 7)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def edge(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, SCHEMA)
    for c in ("size", "score", "k", "part", "sig", "jaccard_key", "mix_copies", "spans_key"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_op1(spark, docs, edge, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_digest(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) > 0.85
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(edge, model).collect()
    assert len(scored) == len(EDGE) and len({r.quality_score for r in scored if not (r.text or "").strip()}) == 1
    assert quality.quality_digest(empty, labels).count() == 0
    none = quality.quality_digest(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]


def plain_features(text):
    """Words, pairs, and runs of one to three word shapes, as plain tuples."""
    words = [w.decode("latin-1") for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    shape = []
    for i, w in enumerate(words):
        kinds = min(sum("A" <= c <= "Z" for c in w), 2), any("a" <= c <= "z" or c > "\x7f" for c in w), any(c.isdigit() and c < "\x7f" for c in w)
        shape.append((kinds, tuple(sorted(c for c in w if 32 < ord(c) < 127 and not c.isalnum())), i > 0 and low[i] == low[i - 1]))
    run = lambda x, k: {tuple(x)} if 0 < len(x) < k else {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    return {("w", w) for w in low} | {("p", *p) for p in run(low, 2)} | {("s", k, *r) for k in (1, 2, 3) for r in run(shape, k)}


def solved(x, y, cost=1.0):
    """Hinge-loss weights (the bias is a feature of one) by projected gradient on the whole dual."""
    x = np.hstack([x, np.ones((len(x), 1))])
    q = (x @ x.T) * y[:, None] * y
    alpha, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(20000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
    return (alpha * y) @ x


def test_op1_against_brute_force(spark, monkeypatch):
    """Every score from plain feature sets, log-count ratios, a dense solver and a logistic fit, with epochs enough to
    converge."""
    monkeypatch.setattr(quality, "dual_coordinate_descent", partial(quality.dual_coordinate_descent, epochs=3000))
    rng = np.random.default_rng(21)
    good, bad, stock = ["calm", "clear", "plain", "fair"], ["BUY", "now!!", "$$$", "free"], ["the", "of", "a", "Été", "x1", "so"]
    rows = [(i, " ".join(rng.choice((good if i % 2 else bad) + stock * 2, int(rng.integers(3, 14))))) for i in range(60)]
    rows += [(100, ""), (101, None), (102, "unseen words alone")]
    labels = [(i, int(i % 2 if i % 11 else 1 - i % 2), 0) for i in range(60)] + [(7, None, 0)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted = [(i, q) for i, q, _ in labels if q is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    sets = {i: plain_features(t or "") for i, t in rows}
    for i, t in rows:
        assert len(quality.features(np.frombuffer((t or "").encode(), np.uint8))) == len(sets[i])
    y = np.array([1.0 if q else -1.0 for _, q in fitted])
    names = sorted((f for f, n in Counter(f for i, _ in fitted for f in sets[i]).items() if n >= quality.LEAST_DOCS), key=repr)
    x = np.array([[f in sets[i] for f in names] for i, _ in fitted], dtype=float)

    def model(at):
        p, n = (1 + x[at][y[at] == side].sum(axis=0) for side in (1, -1))
        r = np.log(p / p.sum()) - np.log(n / n.sum())
        scale = lambda v: v * r / np.maximum(np.linalg.norm(v * r, axis=-1, keepdims=True), 1e-9)
        w = solved(scale(x[at]), y[at])
        return lambda v: scale(v) @ w[:-1] + w[-1]

    fold, margin = np.arange(len(y)) % 3, np.zeros(len(y))
    for k in range(3):
        margin[fold == k] = model(np.flatnonzero(fold != k))(x[fold == k])
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    ab = np.array([1.0, 0.0])
    for _ in range(50000):
        p = 1 / (1 + np.exp(-(ab[0] * margin + ab[1])))
        ab += 0.02 * np.array([(target - p) @ margin, (target - p).sum()])
    final = model(np.arange(len(y)))
    got = {r.doc_id: r.score for r in quality.quality_digest(docs, known).collect()}
    for i, _ in rows:
        want = 1 / (1 + np.exp(-(ab[0] * final(np.array([[f in sets[i] for f in names]], dtype=float))[0] + ab[1])))
        assert abs(got[i] - want) < 0.02, (i, got[i], want)


def test_op1_columns_and_repeated_ids(spark, docs):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs.unionByName(docs), labels)
    same = quality.fit_quality(docs, labels)
    assert (model.vocabulary == same.vocabulary).all() and np.allclose(model.weight, same.weight)
    out = quality.score_quality(docs.limit(5).withColumn("quality_score", F.lit("mine")), same)
    assert out.columns[-2:] == ["quality_score_", "quality_pass"] and {r.quality_score for r in out.collect()} == {"mine"}


def test_op2(spark, docs, rows, edge, empty):
    tok, start = tokenizer("byte_bpe_50k.json"), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in store.store_digest(docs).collect()}
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    path = new_path(spark, "store")
    store.write(edge, path)
    back = {(r.doc_id, tuple(r.ids)) for r in store.decode(spark, path).collect()}
    assert back == {(e[0], tuple(tok.encode(e[1] or "", add_special_tokens=False).ids + [0])) for e in EDGE}
    assert store.digest(spark, path).count() == len(EDGE)
    assert store.store_digest(empty).count() == 0


@pytest.mark.parametrize("part", ["recipes", "chunks", "blocks", "manifest"])
@pytest.mark.parametrize("how", ["missing", "repeated"])
def test_op2_notices_damage(spark, docs, part, how):
    """A row less, or a row twice, in any table of the store raises."""
    path = new_path(spark, "store")
    store.write(docs.limit(40), path)
    table = spark.read.parquet(f"{path}/{part}").toPandas()
    bad = table.iloc[1:] if how == "missing" else table.iloc[[0, *range(len(table))]]
    schema = spark.read.parquet(f"{path}/{part}").schema
    damaged = spark.createDataFrame([tuple(r) for r in bad.itertuples(index=False)], schema)
    damaged.coalesce(1).write.mode("overwrite").parquet(f"{path}/{part}")
    with pytest.raises(Exception, match="missing|repeated|moved|not fit|not whole"):
        store.digest(spark, path).collect()


def test_op2_notices_changes(spark, docs):
    from pyspark.sql import functions as F

    for part, column, value in (("recipes", "n_tokens", F.col("n_tokens") + 1), ("recipes", "doc_id", F.col("doc_id")), ("chunks", "payload", F.concat("payload", F.lit(b"\0\0")))):
        path = new_path(spark, "store")
        store.write(docs.limit(40), path)
        changed = staged(spark.read.parquet(f"{path}/{part}").withColumn(column, value), "changed")
        changed.write.mode("overwrite").parquet(f"{path}/{part}")
        if column == "doc_id":  # no change: still read
            assert store.digest(spark, path).count() == 40
            continue
        with pytest.raises(Exception, match="missing|repeated|moved|not fit|not whole|not hold|add up"):
            store.digest(spark, path).collect()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    """Random texts over an awkward alphabet: ids by way of the memo equal the library's."""
    import random

    rng, tok = random.Random(11), tokenizer(name)
    alphabet = ["a", "B", "é", "İ", "ß", "ﬁ", "Å", "e\u0301", "中", "1", "²", "½", "_", "'s", "'", ".", ",", "!?", "###", " ", " ", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "<|endoftext|>", "\x00", "\x1c", "🙂", "the", "The", "tion"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(6000)]
    ids, ends = Encoder(name).flat(pa.array(texts), 7)
    start = 0
    for text, end, want in zip(texts, ends.tolist(), tok.encode_batch_fast(texts, add_special_tokens=False)):
        assert ids[start:end].tolist() == want.ids + [7], text
        start = end
    if name.startswith("byte"):
        want = [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
        assert tokencount.Merger(name).totals(pa.array(texts)).tolist() == want


def covered(texts, length, first):
    seen = defaultdict(list)
    for i, t in texts:
        for j in range(len(t) - length + 1):
            seen[t[j : j + length]].append((i, j))
    out = {}
    for i, t in texts:
        cov = bytearray(len(t))
        for j in range(len(t) - length + 1):
            places = seen[t[j : j + length]]
            if places[0] < (i, j) if first else len(places) > 1:
                cov[j : j + length] = b"\1" * length
        out[i] = cov
    return out


@pytest.mark.parametrize(("length", "keep", "crowd"), [(400, "none", 1024), (400, "none", 0), (120, "first", 1024), (120, "first", 1)])
def test_op3(docs, rows, length, keep, crowd):
    texts = [(i, t.encode()) for i, t in rows]
    want = covered(texts, length, keep == "first")
    got = {r.doc_id: r for r in substrings.removal_digest(docs, length, keep, crowd).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        kept = bytes(x for x, m in zip(t, want[i]) if not m)
        spans = len([x for x in bytes(want[i]).split(b"\0") if x])
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(want[i]), spans, hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize(("crowd", "hot"), [(1024, 1000), (2, 3), (0, 1)])
def test_op3_periods_and_ids(spark, monkeypatch, keep, crowd, hot):
    """Periodic texts, a passage in many contexts, two texts under one doc_id, rows that repeat a document."""
    import random

    monkeypatch.setattr(substrings, "HOT_COPIES", hot)

    rng = random.Random(12)
    noise = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    passage, texts = noise(300), []
    for i in range(12):
        texts.append((i, noise(rng.randint(0, 90)) + passage + noise(rng.randint(0, 90))))
    texts += [(20, "a" * 400), (21, "xyz" * 150 + "a" * 130), (22, noise(60) + "xy" * 200), (23, "b" * 119), (24, "b" * 120), (25, "b" * 121)]
    texts += [(30, noise(200)), (30, noise(150) + passage[50:250]), (31, "cd" * 4000)]
    texts += [(40, passage), (40, passage), (41, noise(250))] + [(41, texts[-1][1])]
    if keep == "first":
        seen = sorted(set(texts), key=lambda x: x[0])  # repeated rows stand for one document
        by_hash = {x: r.t for x in seen for r in spark.createDataFrame([x], "doc_id long, text string").selectExpr("xxhash64(text) AS t").collect()}
        seen.sort(key=lambda x: (x[0], by_hash[x]))
    else:
        seen = texts
    want, cov = Counter(), covered([((n, i), t.encode()) for n, (i, t) in enumerate(seen)], 120, keep == "first")
    for (n, i), c in cov.items():
        t = seen[n][1].encode()
        want[(i, len(t), sum(c), hashlib.sha256(bytes(x for x, m in zip(t, c) if not m)).hexdigest())] += texts.count(seen[n]) if keep == "first" else 1
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in substrings.removal_digest(df, 120, keep, crowd).collect())
    assert got == want


def test_op3_edges(spark, edge, empty):
    got = substrings.removal_digest(edge).collect()
    assert len(got) == len(EDGE) and {r.n_removed for r in got if r.doc_id == 5} == {len(LONG)} and sum(r.n_removed for r in got if r.doc_id != 5) == 0
    twice = spark.createDataFrame([(1, "ab" * 10 + "x" * 500), (2, "cd" * 10 + "x" * 500), (2, "cd" * 10 + "x" * 500)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in substrings.removal_digest(twice).collect()) == [(1, 500), (2, 520), (2, 520)]
    out = substrings.without_repeats(edge, 400, "first")
    assert out.columns == edge.columns and out.count() == len(EDGE)
    assert substrings.removal_digest(empty).count() == 0


def test_op4(docs, edge, empty):
    got = {r.doc_id: r for r in language.language_digest(docs).collect()}
    known = [r for r in docs.select("doc_id", "lang").collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in known]) > 0.95
    out = language.predict_languages(edge, language.fit_languages(docs)).collect()
    assert {r.doc_id for r in out if r.lang_pred == "und"} == {1, 2, 3, 6} and all(0 <= r.score <= 1 for r in out)
    assert language.language_digest(empty).count() == 0
    assert {r.lang_pred for r in language.predict_languages(edge, language.fit_languages(empty)).collect()} == {"und"}
    model = language.fit_languages(docs)
    two = " ".join(r.text[:1500] for r in docs.where("lang IN ('de', 'fr') AND n_chars > 1500 AND source = 'src1'").orderBy("lang").collect()[:1] + docs.where("lang = 'fr' AND n_chars > 1500").limit(1).collect())
    assert sum(s for _, s in model.infer(np.frombuffer(two.encode(), np.uint8))) == pytest.approx(1, abs=1e-6)


def test_op4_against_brute_force(spark):
    """Counts, proportions and the selected set of languages from plain loops; all sets are tried."""
    from itertools import combinations
    from math import log

    rng = np.random.default_rng(22)
    letters = {"aa": "abcde", "bb": "defgh", "cc": "ghijk", "dd": "abfgk"}
    word = lambda lang: "".join(rng.choice(list(letters[lang]), int(rng.integers(2, 6))))
    rows = [(i, " ".join(word(lang) for _ in range(60)), lang) for i, lang in enumerate(sorted(letters) * 8)]
    rows += [(100 + i, " ".join([word(a) for _ in range(80)] + [word(b) for _ in range(50)]), None) for i, (a, b) in enumerate(combinations(sorted(letters), 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    grams = lambda t: Counter(language.trigrams(np.frombuffer(t.encode(), np.uint8)).tolist())
    total = {lang: Counter() for lang in sorted(letters)}
    for i, t, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 4 != 2:
            total[lang].update(grams(t))
    space = 1 << language.BITS
    p = {lang: lambda g, c=c: (c[g] + language.SMOOTH) / (sum(c.values()) + language.SMOOTH * space) for lang, c in total.items()}

    def mixed(n, langs):
        table, share = {g: [p[x](g) for x in langs] for g in n}, [1 / len(langs)] * len(langs)
        for _ in range(300):
            new = [0.0] * len(langs)
            for g, c in n.items():
                whole = sum(a * b for a, b in zip(table[g], share))
                new = [v + c * a * b / whole for v, a, b in zip(new, table[g], share)]
            share = [v / sum(n.values()) for v in new]
        return share, sum(c * log(sum(a * b for a, b in zip(table[g], share))) for g, c in n.items())

    model = language.fit_languages(docs)
    assert model.names == sorted(letters)
    predicted = {r.doc_id: (r.lang_pred, r.score) for r in language.predict_languages(docs, model).collect()}
    for i, t, _ in rows[::5] + rows[32:]:
        n = grams(t)
        best = max(((mixed(n, s)[1] - language.PENALTY * (len(s) - 1) * log(sum(n.values())), s) for k in (1, 2, 3) for s in combinations(sorted(letters), k)))[1]
        share = sorted(zip([-v for v in mixed(n, best)[0]], best))
        found = model.infer(np.frombuffer(t.encode(), np.uint8))
        assert {x for x, _ in found} == set(best) and predicted[i][0] == share[0][1], (i, found, best)
        assert abs(predicted[i][1] + share[0][0]) < 0.02


def test_op4_repeated_rows_and_too_many_languages(spark, docs):
    twice = language.language_digest(docs.unionByName(docs)).groupBy("doc_id").count().where("count <> 2").count()
    assert twice == 0
    many = spark.createDataFrame([(i, "text here", f"l{i}") for i in range(900)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="lang"):
        language.fit_languages(many)


def test_op5(docs, edge, empty):
    got = mixing.mix_digest(docs).collect()
    taken, targets, most = Counter(), {}, Counter()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for r in got:
        assert r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        targets[source[r.doc_id]] = r.target
        most[source[r.doc_id]] = max(most[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - targets[s]) <= most[s] / 2 + 1 for s in targets)
    assert got == mixing.mix_digest(docs).collect()
    # Inclusion odds differ by document: among those that may be drawn the order of ranks is not that of the numbers.
    u = {i: (int(hashlib.md5(f"mix1:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in source}
    drawn = [r for r in got if r.size and r.target < r.source_size]
    crossed = 0
    for s in {source[r.doc_id] for r in drawn}:
        mine = [r for r in drawn if source[r.doc_id] == s]
        took, left = [r for r in mine if r.taken], [r for r in mine if not r.taken]
        crossed += bool(took and left) and max(u[r.doc_id] for r in took) > min(u[r.doc_id] for r in left)
    assert crossed
    mixed = mixing.pareto_mix(edge)
    assert mixed.count() == len(EDGE) and mixing.repeated(mixed, edge.columns).columns == edge.columns
    assert mixing.mix_digest(empty).count() == 0


def test_op6(docs, rows, edge, empty):
    tok = tokenizer("word_bpe_49k.json")
    for df, texts in ((docs, rows), (edge, [(e[0], e[1] or "") for e in EDGE])):
        pieces, spans = packing.pack(df).collect(), defaultdict(list)
        want = Counter()
        for i, t in texts:
            ids = tok.encode(t, add_special_tokens=False).ids + [2]
            for a in range(0, len(ids), 4096):
                part = ids[a : a + 4096]
                want[(i, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
        assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want
        for p in pieces:
            spans[p.sequence_id].append((p.offset, p.length))
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 4096
    assert packing.pack(empty).count() == 0


def test_op6_bins_and_padding(spark, docs):
    """Whole tables: every group's bins are those of plain first-fit decreasing, and little is padded."""
    many = docs.unionByName(docs).unionByName(docs)
    pieces = packing.pack(many, group=64).collect()
    groups = defaultdict(list)
    for p in pieces:
        groups[p.sequence_id >> 32].append(p)
    assert len(groups) > 5
    for mine in groups.values():
        room, want = [], Counter()
        for size in sorted((p.length for p in mine), reverse=True):
            at = next((i for i, r in enumerate(room) if r >= size), None)
            if at is None:
                room.append(4096)
                at = len(room) - 1
            want[(size, at, 4096 - room[at])] += 1
            room[at] -= size
        assert Counter((p.length, p.sequence_id & (2**32 - 1), p.offset) for p in mine) == want
    fill = Counter()
    for p in pieces:
        fill[p.sequence_id] += p.length
    for p in pieces:
        n = fill[p.sequence_id]
        assert p.padded == (n if n & (n - 1) == 0 else 4096)
    whole = packing.pack(many).collect()
    sequences = {p.sequence_id: p.padded for p in whole}
    assert sum(sequences.values()) / sum(p.length for p in whole) < 1.01
    half = spark.createDataFrame([(1, " ".join(["a"] * 2047))], "doc_id long, text string")
    assert {(p.doc_tokens, p.padded) for p in packing.pack(half).collect()} == {(2048, 2048)}


def test_op7(docs, rows, edge, empty):
    tok = tokenizer("byte_bpe_50k.json")
    for df, texts in ((docs, rows), (edge, [(e[0], e[1] or "") for e in EDGE])):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(df).collect())
        want = Counter()
        for i, t in texts:
            n = len(tok.encode(t, add_special_tokens=False).ids)
            want[(i, len(t.encode()), n, n > 1024)] += 1
        assert got == want
    assert tokencount.count_tokens(empty).count() == 0


def brute_components(rows, rule):
    sets, post, parent = {}, defaultdict(list), {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t)]
        sets[i] = {tuple(w)} if 0 < len(w) < rule.words else {tuple(w[j : j + rule.words]) for j in range(len(w) - rule.words + 1)}
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        both = Counter(j for g in s for j in post[g])
        for j, n in both.items():
            if rule.den * n >= rule.num * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for g in s:
            post[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("rule", [jaccard.Rule(), jaccard.Rule(5, 80, 100), jaccard.Rule(2, 30, 100)])
@pytest.mark.parametrize(("members", "pivots"), [(1024, 32), (3, 2)])
def test_op8(docs, rows, rule, members, pivots):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_components(docs, rule, members, pivots).collect()}
    assert got == brute_components(rows, rule)


def test_op8_chains_and_edges(spark, edge, empty):
    """A chain of near copies whose ends don't link, in chunks of a few members."""
    rng, base = np.random.default_rng(8), [f"w{i}" for i in range(400)]
    rows, words = [], list(base)
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[int(rng.integers(0, 400))] = f"n{i}"
    rows += [(100 + i, " ".join(f"u{i}x{j}" for j in range(50))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for members, pivots in ((1024, 32), (7, 2), (7, 5)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_components(df, jaccard.Rule(), members, pivots).collect()}
        assert got == brute_components(rows, jaccard.Rule())
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.component_digest(edge).collect()]
    assert len(out) == len(EDGE)
    assert sorted(x for x in out if x[0] in (1, 2, 3, 4)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4)]
    kept = jaccard.one_of_each(edge)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 1
    assert jaccard.component_digest(empty).count() == 0
    # Two texts under one doc_id, one of them a copy of an earlier document: the copy goes, the other stays.
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    two = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (3, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.one_of_each(two).collect()) == [(1, a), (2, b)]


@pytest.mark.parametrize("spread", [3, 0, 1000])
def test_op8_divides_regions(spark, monkeypatch, spread):
    """Families of near copies that share half of their text with all others: one region, several cells, some links
    across them; divided by cells, or block by block."""
    monkeypatch.setattr(jaccard, "SPREAD", spread)
    rng, rows = np.random.default_rng(18), []
    stock = [f"s{i}" for i in range(120)]
    for f in range(9):
        own = [f"f{f // 2}x{i}" for i in range(150)]
        for c in range(14):
            words = stock + own
            for j in rng.integers(0, len(words), int(rng.integers(0, 5 + 2 * c))).tolist():
                words[j] = f"n{f}-{c}-{j}"
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rule = jaccard.Rule(2, 80, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_components(df, rule, 10, 4).collect()}
    want = brute_components(rows, rule)
    assert got == want and 5 < len({c for _, c in want.values()}) < 100


def test_op8_common_halves_do_not_meet(spark, monkeypatch):
    """Texts that share half of their words with all others: only near pairs come together in a region that pivots do not
    divide, however many there are; a repeated row changes nothing."""
    monkeypatch.setattr(jaccard, "SPREAD", 0)
    stock = [f"s{i}" for i in range(60)]
    rows = [(i, " ".join(stock + [f"d{i}w{j}" for j in range(60)])) for i in range(800)]
    rows += [(1000 + i, rows[i][1].replace(f"d{i}w7", "other")) for i in range(0, 60, 3)] + rows[:30]
    rule = jaccard.Rule(2, 80, 100)
    sets = {}
    for i, t in rows:
        sets.setdefault(i, jaccard.shingle_set(np.frombuffer(t.encode(), np.uint8), rule.words))
    bodies = [(1, i, i, s.astype("<u8").tobytes()) for i, s in sets.items()] + [(1, 5, 5, sets[5].astype("<u8").tobytes())]
    region = spark.createDataFrame(bodies, "region long, member long, label long, body binary")
    met = {(r.leader, r.member) for r in jaccard._rare_companies(region, rule).collect()}
    assert {(i, m) for i in range(0, 60, 3) for m in (i, 1000 + i)} == met
    found = jaccard._not_told_apart(region, rule, 64)
    assert {tuple(sorted(r)) for f in found for r in f.collect()} == {(i, 1000 + i) for i in range(0, 60, 3)}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_components(df, rule, 64, 4).collect()}
    assert got == {i: (len(s), i - 1000 if i >= 1000 else i) for i, s in sets.items()}


def test_op9_edges(spark):
    v = [(0, [1.0, 2.0]), (50, [float("nan"), 1.0]), (1, None), (2, [1.0, None]), (3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [float("inf"), 0.0]), (100, [-1.0, 0.5]), (None, [1.0, 1.0]), (7, [])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    for shard, block, cells in ((2, 1, 4), (4096, 8192, 256)):
        got = sorted(tuple(r) for r in topk.top_k(df.selectExpr("*", "1 AS size", "2 AS cell", "3 AS id"), shard=shard, block=block, cells=cells).collect())
        assert got == [(0, 1, 3, 5 * 65536), (0, 2, 3, 5 * 65536), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 3, 0), (100, 3, 3, 0)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_op9_against_brute_force(spark):
    """Clusters, ties, many copies of one vector, two lengths, a query id with two vectors, over many small cells."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(0, 3, 6) * 100 + rng.integers(-2, 3, 6)).tolist()) for i in range(300)]
    rows += [(300 + i, [100] * 6) for i in range(150)] + [(500 + i, rng.integers(-5, 5, 4).tolist()) for i in range(60)] + [(50, rows[7][1])]
    df = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    want = {}
    for i, q in rows:
        if i % 50 == 0:
            want.setdefault(i, []).extend((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i and len(v) == len(q))
    want = sorted((i, r, j, -s) for i, found in want.items() for r, (s, j) in enumerate(sorted(found)[:5], 1))
    for shard, block, cells in ((16, 3, 32), (64, 2, 3), (4096, 8192, 256)):
        assert sorted(tuple(r) for r in topk.top_k(df, shard=shard, block=block, cells=cells).collect()) == want


def exact_shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text)]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}


def read_back(fingerprint):
    """Hashes of a fingerprint, and up to which value they are all that the text has."""
    assert len(fingerprint) % 12 == 0
    h = [int(fingerprint[i : i + 12], 16) for i in range(0, len(fingerprint), 12)]
    assert h == sorted(set(h))
    line = 2**48 // 32
    return h, 2**48 if len(h) < 20 else max(h[-1], line - 1) if len(h) == 20 else line - 1


def compared(a, b):
    (x, top), (y, other) = read_back(a), read_back(b)
    x, y = ({v for v in h if v <= min(top, other)} for h in (x, y))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_op10(docs, rows, edge, empty):
    """Against exact shingle sets and fingerprints read back from their digits."""
    got = {r.doc_id: r for r in sketch.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    errors, by_text = [], {}
    for k, (i, t) in enumerate(rows):
        after, r = rows[(k + 1) % len(rows)][1], got[i]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        own, other = exact_shingles(t), exact_shingles(changed)
        h, top = read_back(r.fingerprint)
        assert len(h) == len(own) if len(own) <= 20 else len(h) >= 20 and all(v < 2**48 // 32 for v in h[20:])
        assert abs(len(h) - max(20, len(own) / 32)) <= 5 * (len(own) / 32) ** 0.5 or len(own) <= 20
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert r.near_edited == compared(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == compared(r.fingerprint, got[rows[(k + 1) % len(rows)][0]].fingerprint)
        if own | other:
            errors.append(r.near_edited - len(own & other) / len(own | other))
    assert abs(np.mean(errors)) < 0.02 and np.mean(np.abs(errors)) < 0.1
    assert len({f for f in by_text.values()}) > 0.9 * len(by_text)
    assert sum(len(r.fingerprint) for r in got.values()) < 0.13 * sum(len(t.encode()) for _, t in rows)
    out = sketch.fingerprints(edge).collect()
    assert len(out) == len(EDGE) and {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {""}
    first = next(r for r in out if r.doc_id is None)
    assert first.near_next == 0 and next(r for r in out if r.doc_id == 7).edited_sha256 == hashlib.sha256(sketch.edit(EDGE[8][1], "null id text here").encode()).hexdigest()
    assert sketch.fingerprints(empty).count() == 0
    assert sketch.fingerprints(docs.limit(1)).first().near_next == 1


def test_op10_nulls_and_repeated_ids(spark):
    """Many null doc_ids, and two texts under one doc_id: a ring of next documents in all."""
    rows = [(None, f"null {i} " * 9) for i in range(40)] + [(5, "one text here"), (5, "another text"), (9, "last of all"), (9, "last of all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    order = [(r.doc_id, r.text) for r in df.selectExpr("*", "xxhash64(text) AS h").collect() for _ in [0]]
    hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    order.sort(key=lambda x: (x[0] is not None, x[0] or 0, hashes[x[1]]))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        want[(i, len(t), hashlib.sha256(sketch.edit(t, after).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in sketch.fingerprints(df).collect()) == want


def test_containment_of_unequal_texts():
    words = [f"w{i}" for i in range(20000)]
    whole, part = sketch.sketch(" ".join(words)), sketch.sketch(" ".join(words[500:3500]))
    assert sketch.containment(part, whole) == 1 and abs(sketch.containment(whole, part) - 0.15) < 0.05
    found = [sketch.containment(sketch.sketch(" ".join(words[i : i + 12])), whole) for i in range(0, 2000, 50)]
    assert set(found) <= {1.0, None}  # never a false zero


def test_op5_rows_under_one_id(spark, duck):
    """Rows that share an id, or have none, are decided one by one."""
    import duckdb
    import random

    rng = random.Random(3)
    text = lambda: " ".join("w" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 60)))
    rows = [(None, text(), "a") for _ in range(200)] + [(7, text(), "b") for _ in range(200)] + [(i, text(), "z") for i in range(200)]
    rows += [(9, "one two three four five", "c")] * 900 + [(i, "x y z", None) for i in range(100)] + [(None, None, "d"), (None, "", "d")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix_digest(table).toPandas()
    con, frame = duckdb.connect(), table.toPandas()
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con.register("documents", frame)
    assert rows_of(got) == rows_of(con.sql(mixing.DIGEST_SQL).df())
    mixed = mixing.pareto_mix(table).collect()
    for source in {r[2] for r in rows}:
        mine = [r for r in mixed if r.source == source]
        taken, most = sum(r.mix_copies * r.mix_size for r in mine), max(r.mix_size for r in mine)
        assert abs(taken - mine[0].mix_target) <= most / 2 + 1e-6
    assert sorted(got["taken"]) == sorted(r.mix_copies * r.mix_size for r in mixed)
    partly = {r.mix_copies for r in mixed if r.source == "c"}
    assert len(partly) == 2  # of 900 equal rows some are taken once more


def test_op2_one_id_spreads_and_width_is_checked(spark, docs):
    from pyspark.sql import functions as F

    one = docs.select(F.lit(5).cast("long").alias("doc_id"), "text")
    path = new_path(spark, "store")
    store.write(one, path)
    parts = [r.documents for r in store.manifest(spark, path).collect()]
    assert len(parts) == 4 and max(parts) < 0.5 * sum(parts) and store.digest(spark, path).count() == one.count()
    with pytest.raises(Exception, match="does not fit 1 bytes"):
        store.write(one, new_path(spark, "store"), width=1)


def test_op7_refuses_other_kinds_of_files():
    with pytest.raises(ValueError, match="end_of_word_suffix, normalizer, pre_tokenizer"):
        tokencount.Merger("word_bpe_49k.json")


def test_op9_condition_on_other_columns(spark):
    rows = [(i, [float(i % 7), 1.0], i % 3) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, my_vec_id long")
    got = {(r.query_id, r.rank): r.vec_id for r in topk.top_k(table, is_query="my_vec_id = 0", k=2, shard=4, block=3, cells=4).collect()}
    want = {}
    for i, v, m in rows:
        if m == 0:
            best = sorted((-(int(256 * v[0]) * int(256 * w[0]) + 256 * 256), j) for j, w, _ in rows if j != i)[:2]
            want |= {(i, k + 1): j for k, (_, j) in enumerate(best)}
    assert got == want


def test_op10_one_id_is_divided(spark, docs):
    from pyspark.sql import functions as F

    half = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(100)).otherwise(F.col("doc_id")))
    splits = sketch._splits(half.select("doc_id", F.xxhash64("text").alias("t")), 8)
    assert sum(splits[1] == 100) >= 4
    got = [tuple(r) for r in sketch.fingerprints(half).select("doc_id", "edited_sha256", "fingerprint").collect()]
    order = sorted((r.doc_id, r.t, r.text) for r in half.select("doc_id", "text", F.xxhash64("text").alias("t")).collect())
    after = [t for _, _, t in order[1:]] + [order[0][2]]
    want = [(i, hashlib.sha256(sketch.edit(a, b).encode()).hexdigest(), sketch.hexadecimal(sketch.sketch(a))) for (i, _, a), b in zip(order, after)]
    assert sorted(got) == sorted(want)
