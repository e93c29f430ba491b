"""Very many phrases in one pass over each text."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AUTOMATON_BYTES = 16 << 20


class Phrases:
    """An automaton of phrases in matching form.  A phrase begins where no ASCII letter or digit stands before it; its words
    are joined by a space or by nothing.

    Spaces are taken out of text and phrases; a hit counts if every space that the text has within it stands between two
    words of the phrase."""

    def __init__(self, phrases: list[str]):
        self.machine, self.size = ahocorasick.Automaton(), 0
        held: dict[str, list[tuple[int, frozenset[int]]]] = {}
        for number, phrase in enumerate(phrases):
            words = phrase.split()
            ends, at = [], 0
            for w in words:
                at += len(w)
                ends.append(at)
            if words:
                held.setdefault("".join(words), []).append((number, frozenset(ends[:-1])))
        for joined, of in held.items():
            self.machine.add_word(joined, (len(joined), of))
        self.size = len(held)
        if self.size:
            self.machine.make_automaton()

    def found(self, text: str) -> list[int]:
        """Numbers of the phrases that a text in matching form has, ascending."""
        if not self.size or not text:
            return []
        bare = text.replace(" ", "")
        gaps, at = set(), 0  # places of ``bare`` before which a space stood
        for word in text.split(" "):
            at += len(word)
            gaps.add(at)
        out = set()
        for last, (length, of) in self.machine.iter(bare):
            a = last + 1 - length
            before = bare[a - 1] if a else " "
            if a and a not in gaps and before.isascii() and before.isalnum():
                continue
            inner = [g for g in range(1, length) if a + g in gaps]
            out.update(number for number, joints in of if number not in out and joints.issuperset(inner))
        return sorted(out)


def phrase_hits(texts: DataFrame, phrases: DataFrame, text: str, phrase: str, most_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``texts`` with each of the phrases they have: a row for each pair, both in matching form.

    The phrases become automata of at most ``most_bytes`` of phrases each, sent to all workers: one pass over the texts for
    each, so a single one for hundreds of thousands.  Null or empty phrases are found nowhere, repeated ones once."""
    rows = phrases.select(F.trim(phrase).alias("p")).where("p <> ''").distinct()
    total = rows.agg(F.sum(F.octet_length("p")).alias("n")).first().n or 0
    parts = max(1, -(-total // most_bytes))
    sc, out = texts.sparkSession.sparkContext, None
    for part in range(parts):
        mine = sorted(r.p for r in rows.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == part).collect())  # most_bytes of phrases, about
        held = sc.broadcast(mine)
        made: list[Phrases] = []

        @F.pandas_udf("array<int>")
        def numbers(column: pd.Series) -> pd.Series:
            if not made:
                made.append(Phrases(held.value))  # once a worker
            return column.fillna("").map(made[0].found)

        @F.pandas_udf("string")
        def named(column: pd.Series) -> pd.Series:
            return column.map(held.value.__getitem__)

        one = texts.withColumn("number_", F.explode(numbers(F.col(text)))).withColumn(phrase, named(F.col("number_"))).drop("number_")
        out = one if out is None else out.unionByName(one)
    return out
