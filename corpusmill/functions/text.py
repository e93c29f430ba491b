"""Text and identifier normalisation as Column expressions; Python only where no built-in knows Unicode tables."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stand-ins of the normaliser.
SUBSCRIPTS, SUPERSCRIPTS, DIGITS = "₀₁₂₃₄₅₆₇₈₉", "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
SIGNS, PLAIN_SIGNS = "₊₋⁺⁻", "+-+-"
DASHES = "−‐‑‒–—"
GREEK = {
    "delta": "δ", "Delta": "Δ", "alpha": "α", "beta": "β", "gamma": "γ", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "pi": "π",
    "sigma": "σ", "tau": "τ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω", "theta": "θ", "epsilon": "ε", "varepsilon": "ε",
}
FONT_MACROS = ("mathrm", "mathit", "mathbf", "textrm", "textit", "textbf", "text", "rm", "it", "bf")
ACCENTED = (("'", "e", "é"), ('"', "o", "ö"), ('"', "u", "ü"))
#: Tail characters that a cited identifier may drag along, and words that titles are compared without.
TRAILING = ").,;]|`"
TITLE_STOP = tuple("a an the of in on and or for to with by from at as via is are its into under using based between near".split())


def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape_html(text: Column) -> Column:
    return F.pandas_udf(_unescaped, "string")(text)


def _strip(t: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))


def _stripped(s: pd.Series) -> pd.Series:
    return s.map(_strip, na_action="ignore")


def strip_accents(text: Column) -> Column:
    return F.pandas_udf(_stripped, "string")(text)


def compose_accents(text: Column) -> Column:
    r"""LaTeX accents such as {\'e}, \'{e} or \'e become the accented letter."""
    for mark, base, made in ACCENTED:
        for spelt in ("{\\" + mark + base + "}", "\\" + mark + "{" + base + "}", "\\" + mark + base):
            text = F.replace(text, F.lit(spelt), F.lit(made))
    return text


def strip_tags(text: Column) -> Column:
    return collapse(F.regexp_replace(text, r"<[^<>]*>", " "))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def collapse_unicode(text: Column) -> Column:
    """White space of any kind, the separators x1C to x1F too, as single spaces; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_markup(text: Column, entities: bool = True) -> Column:
    """Plain text of a title or abstract: entities, tags, LaTeX, digits and dashes brought to one form; case is kept."""
    out = F.coalesce(text, F.lit(""))
    if entities:
        out = unescape_html(out)
    out = compose_accents(F.regexp_replace(out, r"<[^>]+>", " "))
    out = F.regexp_replace(out, r"\\(?:" + "|".join(FONT_MACROS) + r")\b", "")
    for name, letter in GREEK.items():
        out = F.replace(out, F.lit("\\" + name), F.lit(letter))
    # One pass for all single characters; what has no stand-in goes.
    gone = "$_^{}"
    out = F.translate(out, SUBSCRIPTS + SUPERSCRIPTS + SIGNS + "µ" + DASHES + gone, DIGITS + DIGITS + PLAIN_SIGNS + "μ" + "-" * len(DASHES))
    return collapse_unicode(out)


def record_text(title: Column, abstract: Column) -> Column:
    """'title. abstract' as plain text."""
    return normalize_markup(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit(""))))


def matching_form(text: Column) -> Column:
    """For comparing phrases: no accents, lower case, dashes as spaces, single spaces."""
    return collapse(F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), r"[-\x{2010}-\x{2015}_/" + DASHES + "]", " "))


def title_identity(text: Column) -> Column:
    """Lower-case ASCII letters and digits of the text without accents and LaTeX commands, everything else one space."""
    plain = F.regexp_replace(strip_accents(F.coalesce(text, F.lit(""))), r"\\[a-zA-Z]+|\$", " ")
    return F.trim(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", " "))


def title_form(text: Column) -> Column:
    """The other form of titles: tags and entities off, lower case, letters and digits of any script kept."""
    plain = F.regexp_replace(unescape_html(F.coalesce(text, F.lit(""))), r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}]+", " "))


def title_tokens(identity_: Column) -> Column:
    """Distinct words of a title identity without stop words."""
    return F.array_distinct(F.filter(F.split(identity_, " "), lambda t: (t != "") & ~t.isin(*TITLE_STOP)))


def slugify(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "_"), F.lit("_"))


def phrase_pattern(phrase: str, loose_left: bool = False) -> str:
    """A pattern for a phrase in matching_form: left boundary only, words joined by an optional space."""
    left = r"(?:^|[^a-z0-9])" if loose_left else r"\b"
    return left + r"\s?".join(w for w in phrase.lower().split())


def canonical_id(raw: Column) -> Column:
    """Trailing punctuation off, prefix in lower case; no version on arXiv ids, the other kinds in lower case; null for
    an unknown prefix or none."""
    bare = F.ltrim(F.rtrim(F.trim(raw), F.lit(TRAILING)), F.lit("`"))
    at = F.instr(bare, ":")
    prefix, rest = F.lower(F.substr(bare, F.lit(1), at - 1)), F.substr(bare, at + 1)
    arxiv = F.concat(F.lit("arxiv:"), F.regexp_replace(rest, r"(?i)v\d+$", ""))
    return F.when(at > 0, F.when(prefix == "arxiv", arxiv).when(prefix.isin("doi", "hal", "osti"), F.concat(prefix, F.lit(":"), F.lower(rest))))


#: The four shapes of a cited identifier.
CITED = r"(?i)\b(?:arXiv:\d{4}\.\d{4,5}(?:v\d+)?|doi:10\.\d{4,9}/[^\s`<>\"'\]|]+|hal:hal-\d+|osti:\d+)"


def citations(text: Column) -> Column:
    """Canonical identifiers cited in a text, each once, in order of first appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITED), F.lit(0))
    return F.array_distinct(F.array_compact(F.transform(found, canonical_id)))


def citation_groups(text: Column) -> Column:
    """Keys of all groups [@key] or [@key1; @key2] in a text, in order, repeats kept."""
    key = r"[\w:./-]+"
    groups = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\[\s*@{key}(?:\s*;\s*@{key})*\s*\]"), F.lit(0))
    return F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(f"@({key})"), F.lit(1))))


def arxiv_number(text: Column) -> Column:
    """The bare number in an arXiv id, URL or DOI, new style before old, without version; null if there is none."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^(arxiv:|https?://arxiv\.org/(abs|pdf)/|10\.48550/arxiv\.)", "")
    new, old = F.regexp_extract(bare, r"(?:^|\D)(\d{4}\.\d{4,5})(?:\D|$)", 1), F.regexp_extract(bare, r"(?:^|[^a-z\-])([a-z\-]+(?:\.[A-Z]{2})?/\d{7})(?:\D|$)", 1)
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))


def arxiv_of_record(relations: Column, abstract: Column) -> Column:
    """The first number among related identifiers, or else one that the abstract names."""
    named = arxiv_number(F.regexp_extract(F.coalesce(abstract, F.lit("")), r"(?i)arxiv:\s*\S+", 0))
    return F.coalesce(F.try_element_at(F.array_compact(F.transform(relations, arxiv_number)), F.lit(1)), named)


def ids_between(ids: Column, first: int, last: int) -> Column:
    """Those of an array of new-style numbers whose YYMM stands in a closed range."""
    return F.filter(ids, lambda x: x.rlike(r"^\d{4}\.\d{4,5}$") & F.coalesce(F.substring(x, 1, 4).try_cast("int").between(first, last), F.lit(False)))


def split_version(doi: Column) -> Column:
    """struct(base, number, separator) of an id that ends in a version."""
    p = r"^(.*)([/.\-])v(\d+)$"
    has = doi.rlike(p)
    return F.struct(
        F.when(has, F.regexp_extract(doi, p, 1)).otherwise(doi).alias("base"),
        F.when(has, F.regexp_extract(doi, p, 3).cast("int")).alias("number"),
        F.when(has, F.regexp_extract(doi, p, 2)).alias("separator"),
    )


def identity(kind: Column, raw: Column) -> Column:
    """kind:value with the spellings of one thing brought together."""
    low = F.lower(F.trim(raw))
    doi = F.regexp_replace(low, r"^(https?://(dx\.)?doi\.org/|doi:)", "")
    arxiv = F.regexp_replace(F.regexp_replace(low, r"^(https?://arxiv\.org/abs/|arxiv:)", ""), r"v\d+$", "")
    url = F.regexp_replace(F.trim(raw), "/+$", "")
    return F.concat(kind, F.lit(":"), F.when(kind == "doi", doi).when(kind == "arxiv", arxiv).otherwise(url))


def person_key(name: Column) -> Column:
    """Initial and last name, without accents: 'Shibauchi, T.' and 'T. Shibauchi' agree."""
    plain = F.trim(F.regexp_replace(F.lower(strip_accents(name)), r"[.]", " "))
    comma = plain.contains(",")
    last = F.when(comma, F.trim(F.split_part(plain, F.lit(","), F.lit(1)))).otherwise(F.element_at(F.split(plain, r"\s+"), -1))
    first = F.when(comma, F.trim(F.split_part(plain, F.lit(","), F.lit(2)))).otherwise(plain)
    return F.trim(F.concat(F.substring(first, 1, 1), F.lit(" "), last))


def short_authors(names: Column, most: int = 3) -> Column:
    listed = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(listed, F.lit(" et al."))).otherwise(listed)


def author_names(given: Column, family: Column, name: Column) -> Column:
    """'given family', or the name as it is where there is no family name."""
    return F.coalesce(F.when(F.coalesce(F.trim(family), F.lit("")) != "", F.trim(F.concat_ws(" ", given, family))), F.trim(name))


def bare_author(name: Column) -> Column:
    """A name without the ORCID and affiliation behind it."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*[\[(](?i:orcid)[^\])]*[\])]", ""), r"\s*\[[^\]]*\]\s*$", ""))


def date_from_parts(parts: Column) -> Column:
    """[year, month?, day?] as a date, missing parts 1, null without a year."""
    return F.make_date(F.try_element_at(parts, F.lit(1)), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(1)), F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit(1)))


def strict_date(text: Column) -> Column:
    """Only whole dates: '2025-11' is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bigrams(tokens: Column, drop: list[str], least: int = 2) -> Column:
    """Adjacent pairs of the tokens that are neither stop words nor shorter than ``least``."""
    kept = F.filter(tokens, lambda t: (F.length(t) >= least) & ~t.isin(drop))
    n = F.size(kept)
    return F.when(n > 1, F.zip_with(F.slice(kept, 1, F.greatest(n - 1, F.lit(1))), F.slice(kept, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
