"""Passages of more than 50 short words are cut, however few bytes they have."""

import random
import re
from collections import defaultdict

import numpy as np

import corpus_pipeline
from corpusmill.llm import substrings


def brute(texts, length, words):
    """Texts without the bytes that a string of ``length`` bytes, or of so many words, covers which an earlier place has."""
    seen, at = {}, defaultdict(list)
    for i, t in texts:
        w = [m.span() for m in re.finditer(rb"[^ \t\n\r\v\f]+", t) if re.search(rb"[A-Za-z0-9\x80-\xff]", m[0])]
        strings = [("b", t[j : j + length], j) for j in range(len(t) - length + 1)]
        strings += [("w", t[w[j][0] : w[j + words - 1][1]], w[j][0]) for j in range(len(w) - words + 1)]
        for kind, x, j in strings:
            if kind == "b" or len(x) < length:
                at[i].append((j, len(x), seen.setdefault((kind, x), (i, j)) != (i, j)))
    out = {}
    for i, t in texts:
        cov = bytearray(len(t))
        for j, n, again in at[i]:
            if again:
                cov[j : j + n] = b"\1" * n
        out[i] = bytes(x for x, m in zip(t, cov) if not m)
    return out


def test_short_words(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 4)))
    passage, shorter = " ".join(word() for _ in range(51)), " ".join(word() for _ in range(50))
    assert len(passage) < corpus_pipeline.PASSAGE_BYTES
    rows = [(1, f"one {passage} two"), (2, f"three {passage} four"), (3, f"five {shorter} six"), (4, f"seven {shorter} | # eight"), (5, None), (6, "a b " * 40), (7, f"x{passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    assert got[1] == rows[0][1] and got[2] == "three  four" and got[3] == rows[2][1] and got[4] == rows[3][1] and got[5] is None
    assert got[7] == rows[6][1]  # its first word is another one


def test_against_brute_force(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 5))) for _ in range(30)] + ["|", "--"]
    pool = [" ".join(rng.choices(words, k=rng.randint(4, 40))) for _ in range(25)]
    texts = [(i, rng.choice([" ", "\n", " \n"]).join(rng.choices(pool, k=rng.randint(1, 6)))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    want = brute([(i, t.encode()) for i, t in texts], 60, 14)
    for crowd in (1024, 0):
        got = {r.doc_id: r.text for r in substrings.without_repeats(docs, 60, "first", crowd, words=14).collect()}
        # Characters that a span only ends stay whole in one and are parted in the other.
        assert {i: t.replace("é", "") for i, t in got.items()} == {i: t.decode(errors="ignore").replace("é", "") for i, t in want.items()}
    assert any(substrings.word_windows(np.frombuffer(t.encode(), np.uint8), 14, 60)[0].size for _, t in texts)
