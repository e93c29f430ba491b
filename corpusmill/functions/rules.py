"""Ordered rule sets compiled into Column expressions: every text is scanned once per pattern, never joined to rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    key: str
    pattern: str
    exclude: str | None = None
    residual: bool = False
    kind: str = ""


@dataclass(frozen=True)
class RuleSet:
    """Rules in order of priority; residual ones count only where no other does, and one of them at most."""

    rules: tuple[Rule, ...]
    keys: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "keys", tuple(r.key for r in self.rules))

    def hit(self, rule: Rule, text: Column, title: Column | None = None, least: int = 1) -> Column:
        found = F.regexp_count(text, F.lit(rule.pattern)) >= least if least > 1 else text.rlike(rule.pattern)
        if title is not None:
            found = title.rlike(rule.pattern) | found
        return found & ~text.rlike(rule.exclude) if rule.exclude else found

    def labels(self, text: Column, title: Column | None = None, least: int = 1) -> Column:
        regular = F.array_compact(F.array(*[F.when(self.hit(r, text, title, least), r.key) for r in self.rules if not r.residual]))
        rest = [F.when(self.hit(r, text, title, least), r.key) for r in self.rules if r.residual]
        if not rest:
            return regular
        # The lambda binds the regular labels, so that their patterns run once and the residual ones only if needed.
        return F.transform(F.array(regular), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array_compact(F.array(F.coalesce(*rest)))))[0]

    def of_kind(self, kind: str) -> list[str]:
        return [r.key for r in self.rules if r.kind == kind]


def primary(labels: Column) -> Column:
    return F.try_element_at(labels, F.lit(1))


def or_unclassified(labels: Column) -> Column:
    return F.when(F.size(labels) == 0, F.array(F.lit("unclassified"))).otherwise(labels)


def evidence(text: Column, title: Column, pattern: str) -> Column:
    """One hit in the title, or two that don't overlap in the text."""
    return title.rlike(pattern) | (F.regexp_count(text, F.lit(pattern)) >= 2)


def first_match(text: Column, rules: list[tuple[str, str]], default: str, also: tuple[str, str] | None = None) -> Column:
    """The name of the first pattern that matches; ``also`` adds '+name' where its pattern does."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return F.concat_ws("+", out, F.when(text.rlike(also[1]), also[0])) if also else out


def snippet(text: Column, pattern: str, around: int = 50) -> Column:
    """The first match with as many characters on either side."""
    at, n = F.regexp_instr(text, F.lit(pattern)), F.length(F.regexp_substr(text, F.lit(pattern)))
    begin = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.substr(text, begin, at - begin + n + around))


def cs(pattern: str) -> str:
    """A pattern that keeps case, whatever stands around it."""
    return f"(?-i:{pattern})"


def ci(pattern: str) -> str:
    return f"(?i:{pattern})"


def join(*patterns: str) -> str:
    return "|".join(patterns)


def formula_group(formulas: list[str]) -> str:
    """Any of the formulas (patterns), standing on its own."""
    return cs(r"(?<![A-Za-z0-9])(?:" + join(*formulas) + r")(?![A-Za-z0-9])")
