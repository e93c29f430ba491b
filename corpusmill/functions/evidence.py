"""Expressions that need the positions of matches, element symbols or difflib: Arrow UDFs, one pass a text."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The chemical elements.
ELEMENTS = frozenset(
    """H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag
    Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np
    Pu Am Cm Bk Cf Es Fm Md No Lr""".split()
)
RATIO, PREFIX_WORDS, LOOK_BACK = 0.92, 5, 80


@dataclass(frozen=True)
class TwoTier:
    """strong: enough without a hedge before it; weak: ``weak_least`` times without one, in a context that has a cue.

    A context is one with a match of ``cue``, or of ``reliable`` (patterns that are trusted on their own), or, if
    ``theory`` is given, one without a match of that."""

    strong: str
    weak: str | None
    cue: str
    hedge: str
    weak_least: int = 1
    reliable: tuple[str, ...] = ()
    theory: str | None = None


def unhedged(pattern: re.Pattern, hedge: re.Pattern, text: str) -> int:
    """Matches with no hedge word in the 80 characters before them."""
    return sum(1 for m in pattern.finditer(text) if not hedge.search(text[max(0, m.start() - LOOK_BACK) : m.start()]))


def two_tier(text: Column, rule: TwoTier) -> Column:
    """struct(strong_hits, weak_hits, in_context, matched); both kinds of hits are without a hedge."""

    def run(s: pd.Series) -> pd.DataFrame:
        strong, cue, hedge = (re.compile(p) for p in (rule.strong, rule.cue, rule.hedge))
        weak, theory = (re.compile(p) if p else None for p in (rule.weak, rule.theory))
        trusted = [re.compile(p) for p in rule.reliable]
        rows = []
        for t in s:
            t = t or ""
            context = bool(cue.search(t)) or any(p.search(t) for p in trusted) or (theory is not None and not theory.search(t))
            a, b = unhedged(strong, hedge, t), unhedged(weak, hedge, t) if weak else 0
            rows.append((a, b, context, a > 0 or (context and b >= max(rule.weak_least, 1))))
        return pd.DataFrame(rows, columns=["strong_hits", "weak_hits", "in_context", "matched"])

    return F.pandas_udf(run, "strong_hits int, weak_hits int, in_context boolean, matched boolean")(text)


#: Counts of a symbol, phase prefixes, and what looks like a formula but names no compound under study.
_COUNT = r"(?:\d+(?:\.\d+)?|[-+]?[xyδ])*"
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9])(?:(?:[1-6][TRH]'?|Td|[αβγδεκλ])-)?((?:[A-Z][a-z]?{_COUNT}){{2,}})(?![A-Za-z0-9])")
_PART = re.compile(rf"([A-Z][a-z]?)({_COUNT})")
GENERIC = frozenset("H2O D2O CO2 CO NH3 CH4 HCl NaCl LiF CaF2 N2O SiO2 Al2O3 MgO Si3N4 SiN TiO2 Ta2O5 CaH2".split())
ACRONYMS = frozenset("SU2 SU3 SO3 SO5 CP1 CP2 SYK2 HC2 SC1 SC2 SC3".split())
_UNIT = re.compile(r"(?:[A-Z][a-z]?O[3-6]|CuO2|NiO2)")
_TYPE_AFTER = re.compile(r"[- ](?:type|structure|structured)\b")
_PLURAL = re.compile(r"[A-Z]+s")
_WIDE = re.compile(r"\d{3}")


_OPEN_END = re.compile(r"(?:[-+][xy]|[-+]?δ)$")
#: What a candidate is instead of a formula, in the order in which it is asked.
_NAMES = (("generic", GENERIC.__contains__), ("acronym", ACRONYMS.__contains__), ("unit", _UNIT.fullmatch), ("plural", _PLURAL.fullmatch))


def verdict_of(body: str) -> tuple[str, str]:
    """The body without an open stoichiometry at its end, and 'formula', or what speaks against it: a name that is none, a
    symbol that is no element, one element only, a count of three digits, or single letters without a count."""
    body = _OPEN_END.sub("", body)
    for verdict, holds in _NAMES:
        if holds(body):
            return body, verdict
    at, symbols, counted, wide = 0, set(), False, False
    while at < len(body):  # a symbol and its count
        part = _PART.match(body, at)
        if part is None or part[1] not in ELEMENTS:
            return body, "element"
        symbols.add(part[1])
        counted, wide = counted or bool(part[2]), wide or bool(_WIDE.search(part[2]))
        at = part.end()
    if wide:
        return body, "count"
    if len(symbols) < 2:
        return body, "single"
    return body, "formula" if counted or max(map(len, symbols)) > 1 else "letters"


def candidates(text: str | None) -> list[tuple[str, str]]:
    """Each candidate of a text, in order, with its verdict; 'context' where it is a piece of a parenthesised formula or
    names a type of structure."""
    text, out = text or "", []
    for m in _CANDIDATE.finditer(text):
        inside = text.startswith("(", max(0, m.start() - 1)) and m.start() > 0 or text.startswith(("(", ")"), m.end())
        out.append((m[1], "context") if inside or _TYPE_AFTER.match(text, m.end()) else verdict_of(m[1]))
    return out


def formulas_in(text: str | None) -> list[str]:
    """Formulas of a text, each once, in order."""
    return list(dict.fromkeys(body for body, verdict in candidates(text) if verdict == "formula"))


def _formulas(s: pd.Series) -> pd.Series:
    return s.map(formulas_in)


def formulas(text: Column) -> Column:
    return F.pandas_udf(_formulas, "array<string>")(text)


def _verdicts(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [verdict for _, verdict in candidates(t)])


def formula_verdicts(text: Column) -> Column:
    """The verdict on each candidate of a text, in order."""
    return F.pandas_udf(_verdicts, "array<string>")(text)


def plain_title(t: str | None) -> str:
    return re.sub(r"[\W_]+", " ", t or "").strip().lower()


def same_title(a: str | None, b: str | None) -> bool:
    """Equal up to case and punctuation, a word prefix of five words or more, or a sequence ratio of 0.92."""
    x, y = plain_title(a), plain_title(b)
    if not x or not y:
        return False
    short, long = sorted((x.split(), y.split()), key=len)
    if len(short) >= PREFIX_WORDS and long[: len(short)] == short:
        return True
    match = difflib.SequenceMatcher(None, x, y)
    # Bounds by length and by characters first: linear for what cannot match.
    return match.real_quick_ratio() >= RATIO and match.quick_ratio() >= RATIO and match.ratio() >= RATIO


def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([same_title(x, y) for x, y in zip(a, b)], dtype=bool)


def titles_match(a: Column, b: Column) -> Column:
    return F.pandas_udf(_same, "boolean")(a, b)
