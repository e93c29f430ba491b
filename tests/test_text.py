import pytest
from pyspark.sql import functions as F

from corpusmill.functions import evidence, rules
from corpusmill.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [("La$_3$Ni$_2$O$_7$", "La3Ni2O7"), ("La_3Ni_2O_7", "La3Ni2O7"), ("La₃Ni₂O₇", "La3Ni2O7"), (r"O$_{7-\delta}$", "O7-δ"), (r"$\mathrm{Sr}$", "Sr"), (r"<i>Moir\'e</i> bands", "Moiré bands"), ("5 µm", "5 μm"), ("−1", "-1"), ("a &amp; b", "a & b"), (None, "")],
)
def test_normalize(spark, raw, want):
    assert one(spark, T.normalize_markup, raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("arXiv:2401.01234v2).", "arxiv:2401.01234"), ("ARXIV:2401.01234", "arxiv:2401.01234"), ("DOI:10.1/ABC,", "doi:10.1/abc"), ("hal:HAL-1`", "hal:hal-1"), ("`osti:7;", "osti:7"), ("foo:ABC", None), ("no prefix", None), (":x", None)],
)
def test_canonical_id(spark, raw, want):
    assert one(spark, T.canonical_id, raw) == want


def test_small_functions(spark):
    assert one(spark, T.slugify, "Moiré — Bands!") == "moire_bands"
    assert one(spark, T.person_key, "T. Shibauchi") == one(spark, T.person_key, "Shibauchi, T.") == "t shibauchi"
    assert one(spark, T.matching_form, "Moiré-Band  X") == "moire band x"
    assert one(spark, T.strict_date, "2025-11") is None and str(one(spark, T.strict_date, "2025-11-03")) == "2025-11-03"
    assert tuple(one(spark, T.split_version, "10.1/x/v3")) == ("10.1/x", 3, "/")
    assert one(spark, lambda c: T.identity(F.lit("doi"), c), "https://doi.org/10.1/X") == "doi:10.1/x"
    words = spark.range(1).select(T.bigrams(F.array(*map(F.lit, ["the", "big", "of", "cat", "x"])), ["the", "of"]).alias("x")).first().x
    assert words == ["big cat"]


def test_rules(spark):
    rs = rules.RuleSet((rules.Rule("a", "foo"), rules.Rule("b", "bar", exclude="nobar"), rules.Rule("r1", "baz", residual=True), rules.Rule("r2", "ba", residual=True)))
    lab = lambda t: one(spark, rs.labels, t)
    assert lab("foo bar") == ["a", "b"] and lab("nobar foo") == ["a"] and lab("baz") == ["r1"] and lab("bat") == ["r2"] and lab("zzz") == []
    ev = lambda t, title: one(spark, lambda a, b: rules.evidence(a, b, "spin"), t, title)
    assert ev("spin", "none") is False and ev("spin spin", "none") is True and ev("x", "spin") is True
    assert one(spark, lambda c: rules.first_match(c, [("x", "a"), ("y", "b")], "z", ("w", "q")), "bq") == "y+w"
    assert one(spark, lambda c: rules.snippet(c, "mid", 2), "abcmiddef") == "bcmidde"


def test_markup_order(spark):
    """Entities before tags, tags as spaces, signs and all dashes, odd spaces."""
    for raw, want in (("a&lt;b&gt;c", "a c"), (r"x₊y⁻ \\phi\\Delta \\varepsilon".replace("\\\\", "\\"), "x+y- φΔ ε"), ("TaSe<sub>2</sub>", "TaSe 2"), ("a\u00a0b\x1fc", "a b c"), ("5µm — 6‑7", "5μm - 6-7"), (r"\textbf{A}\textit b", "A b"), ("", ""), (None, "")):
        assert one(spark, T.normalize_markup, raw) == want, raw
    assert one(spark, T.record_text, "T", None) == "T."


def test_citations(spark):
    text = "see arXiv:2401.01234v2, DOI:10.1000/ABC.1). and HAL:hal-77 osti:5; again arxiv:2401.01234 [@k1; @z:1/x-2] [@k1] [k9]"
    assert one(spark, T.citations, text) == ["arxiv:2401.01234", "doi:10.1000/abc.1", "hal:hal-77", "osti:5"]
    assert one(spark, T.citation_groups, text) == ["k1", "z:1/x-2", "k1"]


@pytest.mark.parametrize(("raw", "want"), [("arXiv:2309.00001v3", "2309.00001"), ("https://arxiv.org/pdf/2309.00001", "2309.00001"), ("10.48550/arXiv.2310.01234", "2310.01234"), ("cond-mat/9901001", "cond-mat/9901001"), ("10.1103/PhysRev", None), (None, None)])
def test_arxiv_number(spark, raw, want):
    assert one(spark, T.arxiv_number, raw) == want


def test_authors(spark):
    assert one(spark, T.bare_author, "Doe, J. [ORCID:0000-1]") == "Doe, J." and one(spark, T.bare_author, "Doe (ORCID 1) [CERN]") == "Doe"
    assert one(spark, T.author_names, "A.", "Bo", "x") == "A. Bo" and one(spark, T.author_names, None, "", " Group ") == "Group"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("La3Ni2O7, MnTe2 and THST NATO; CO", ["La3Ni2O7", "MnTe2"]),
        ("La3Ni2O7-δ YBa2Cu3O7-x Bi2Sr2CaCu2O8+x", ["La3Ni2O7", "YBa2Cu3O7", "Bi2Sr2CaCu2O8"]),
        ("1T-TaS2, Td-WTe2, α-RuCl3", ["TaS2", "WTe2", "RuCl3"]),
        ("Co2(PO4)2 and (FeSe)", []),
        ("NiAs-type MnTe, ThCr2Si2 structure", ["MnTe"]),
        ("BCS, NV, SC2024, BICs, SU2, FeO6, CuO2 planes, H2O", []),
        ("La0.7Sr0.3MnO3 at 300 K", ["La0.7Sr0.3MnO3"]),
        ("Xx2O3 and FeFe", []),
        ("FeSe FeSe", ["FeSe"]),
        (None, []),
    ],
)
def test_formulas(text, want):
    assert evidence.formulas_in(text) == want


def test_two_tier(spark):
    rule = evidence.TwoTier(r"\bARPES\b", r"\bspectr\w+", r"measured", r"\b(not|may)\b", 2, (r"\bSTM\b",), r"\btheory\b")
    far = " filler" * 20
    cases = {
        "ARPES shows": (1, 0, True, True),
        "may ARPES": (0, 0, True, False),
        "not spectra, not spectrum measured": (0, 0, True, False),
        f"not{far} spectra{far} spectrum theory": (0, 2, False, False),
        f"not{far} spectra{far} spectrum theory STM": (0, 2, True, True),
        "spectra measured": (0, 1, True, False),
        "spectra and spectrum": (0, 2, True, True),
        None: (0, 0, True, False),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for r in df.select("t", evidence.two_tier(F.col("t"), rule).alias("r")).collect():
        assert tuple(r.r) == cases[r.t], r.t


def test_same_title():
    assert evidence.same_title("A study of the big red cat", "A study of the big red cat: part two")
    assert not evidence.same_title("A study", "Another thing")
    assert evidence.same_title("Kagome metals", "kagome metals.")
    assert not evidence.same_title("", "x") and not evidence.same_title("a b c d", "a b c d e f g h")
