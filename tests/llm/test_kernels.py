import numpy as np
import pytest

from corpusmill.llm import kernels as K
from corpusmill.llm import mixing, packing, quality, sketch, store, substrings, topk


def b(text):
    return np.frombuffer(text.encode(), dtype=np.uint8)


def test_words_do_not_depend_on_cuts(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join("x" * int(n) for n in rng.integers(1, 90, 400)) + "\t\n end " + "y" * 300
    want = K.word_hashes(b(text))
    assert len(want) == len(text.split())
    monkeypatch.setattr(K, "BLOCK", 128)
    got = K.word_hashes(b(text))
    short = np.array([len(w) <= 128 for w in text.split()])
    assert (got[short] == want[short]).all() and len(got) == len(want)


def test_words_and_shingles():
    h = K.word_hashes(b("The cat\x0bsat on the CAT"))
    assert len(h) == 5 and h[1] == h[4] and h[0] == h[3]
    assert len(K.shingles(h, 4)) == 2 and len(K.shingles(h[:2], 4)) == 1 and len(K.shingles(h[:0], 4)) == 0
    assert K.shingles(h[:2], 4)[0] != K.shingles(h[:3], 4)[0]


def test_sliding_min():
    x = np.random.default_rng(2).integers(0, 1000, 97).astype(np.uint64)
    for w in (1, 2, 7, 97):
        assert (K.sliding_min(x, w) == [x[i : i + w].min() for i in range(len(x) - w + 1)]).all()


def test_window_hashes():
    t = b("abcabcabcabd")
    h = K.window_hashes(t, 3)
    assert h[0] == h[3] == h[6] and h[0] != h[9] and len(h) == 10


def test_dual_coordinate_descent_separates():
    rows, y = [np.array([0, 2]), np.array([1, 2])] * 20, np.array([1.0, -1.0] * 20)
    w = quality.dual_coordinate_descent(rows, [np.ones(2)] * 40, y, 3)
    assert all(np.sign(w[r].sum() + w[-1]) == t for r, t in zip(rows, y))


def test_first_fit_decreasing():
    rng = np.random.default_rng(3)
    sizes = sorted(rng.integers(1, 101, 500).tolist(), reverse=True)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room, want = [], []
    for s in sizes:
        at = next((i for i, r in enumerate(room) if r >= s), None)
        if at is None:
            room.append(100)
            at = len(room) - 1
        want.append((at, 100 - room[at]))
        room[at] -= s
    assert list(zip(bins.tolist(), offsets.tolist())) == want


def test_crc_is_linear():
    import zlib

    rng = np.random.default_rng(4)
    for n, m in ((0, 5), (7, 0), (100, 4096), (33, 70000)):
        x, y = rng.bytes(n), rng.bytes(m)
        moved = store.crc_shift(np.array([zlib.crc32(x)]), np.array([m]))[0]
        assert int(moved) ^ zlib.crc32(y) == zlib.crc32(x + y)


def test_chunks_follow_content():
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 50000, 20000).astype(np.uint32)
    cuts = store.cut_points(ids)
    assert cuts[-1] == len(ids) and all(y - x <= store.MOST for x, y in zip([0, *cuts], cuts))
    moved = store.cut_points(np.concatenate([rng.integers(0, 50000, 37).astype(np.uint32), ids]))
    assert len({c + 37 for c in cuts} & set(moved)) > 0.9 * len(cuts)
    assert store.cut_points(np.zeros(9000, np.uint32))[-1] == 9000


def test_merkle_root_depends_on_every_leaf():
    leaves = [bytes([i]) for i in range(7)]
    roots = {store.merkle_root(leaves[:i] + [b"x"] + leaves[i + 1 :]) for i in range(7)} | {store.merkle_root(leaves), store.merkle_root(leaves[:-1])}
    assert len(roots) == 9


def test_prefix_ranks_and_matches():
    rng = np.random.default_rng(6)
    t = rng.integers(97, 99, 300).astype(np.uint8)
    for length in (5, 8, 13):
        ranks = substrings.prefix_ranks(t, length)
        at = np.arange(len(t) - length + 1)
        windows = [t[i : i + length].tobytes() for i in at]
        order = sorted(range(len(at)), key=lambda i: windows[i])
        assert [ranks[i] for i in order] == sorted(ranks[at])
        earlier, later = substrings.matched_windows(ranks[at], at)
        assert earlier.tolist() == [w in windows[:i] for i, w in enumerate(windows)]
        assert later.tolist() == [w in windows[i + 1 :] for i, w in enumerate(windows)]


def test_sketches_merge():
    words = [f"w{i}" for i in range(3000)]
    a, c = sketch.sketch(" ".join(words[:2000])), sketch.sketch(" ".join(words[1000:]))
    assert abs(sketch.likeness(a, c) - 1 / 3) < 0.12
    assert abs(sketch.containment(sketch.sketch(" ".join(words[:500])), a) - 1) < 0.01
    whole = sketch.merge(a, c)
    assert set(whole) <= set(a) | set(c) and len(whole) > len(a)
    assert len(sketch.sketch("")) == 0 and len(sketch.sketch("one")) == 1 and sketch.likeness(sketch.sketch(""), a) == 0


def test_tree_search_is_exact():
    rng = np.random.default_rng(7)
    v = rng.integers(-200, 200, (900, 8)).astype(float)
    v[100:300] = v[0]  # ties
    ids = rng.permutation(900)
    best = [[] for _ in range(20)]
    for a in (0, 450):
        topk.search(topk.Tree(ids[a : a + 450], v[a : a + 450]), ids[:20], v[:20], best, 5)
    for q in range(20):
        want = sorted(((-float(v[i] @ v[q]), int(ids[i])) for i in range(900) if ids[i] != ids[q]))[:5]
        assert sorted((-s, -m) for s, m in best[q]) == want


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 100, "b": 1, "c": 1}, {"a": 0, "b": 7, None: 5}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, n) for k, n in sizes.items()], "source string, size long")
    got = {r.source: r for r in mixing.source_targets(df, 1.5, 2.0, (5, 2, 1)).collect()}
    total = sum(sizes.values())
    assert abs(sum(r.target for r in got.values()) - 1.5 * total) < 1e-6
    assert all(r.target <= 2 * r.source_size + 1e-9 for r in got.values())


def test_sweep(spark):
    from corpusmill.llm.shared import mark, staged, sweep

    since = mark()
    first, last = staged(spark.range(5).toDF("a"), "sweep"), staged(spark.range(7).toDF("a"), "sweep")
    assert first.count() == 5 and sweep(spark, since, keep=last) == 1 and last.count() == 7
    assert sweep(spark, since) == 1
