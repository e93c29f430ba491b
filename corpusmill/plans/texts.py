"""Normalisation, identifiers, citations and Markdown over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import rules as L
from ..functions import text as T
from ..operators import markup as M
from ..operators import sequences
from .common import Registry, spread, table

registry = Registry()


_MARKUP = (
    r" La$_{3}$Ni$_2$O$_{7-\delta}$ &amp; x₊y⁻ \phi \Delta \varepsilon",
    r" <i>TaSe<sub>2</sub></i> &lt;b&gt; Schr\"{o}dinger {\'e} \mathrm{d}x µ—",
    " a\u00a0b\u2003c ¹² −5 \x1f\n\t end",
    "",
)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain_sql(text: str) -> str:
    """The normaliser in SQL, for texts whose only entities are those of _MARKUP."""
    out = f"replace(replace(replace({text}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    for mark, base, made in T.ACCENTED:
        for spelt in ("{\\" + mark + base + "}", "\\" + mark + "{" + base + "}", "\\" + mark + base):
            out = f"replace({out}, {_q(spelt)}, '{made}')"
    out = f"regexp_replace({out}, '\\\\(?:{'|'.join(T.FONT_MACROS)})\\b', '', 'g')"
    for name, letter in T.GREEK.items():
        out = f"replace({out}, {_q(chr(92) + name)}, '{letter}')"
    out = f"translate({out}, '₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹₊₋⁺⁻µ−‐‑‒–—$_^{{}}', '01234567890123456789+-+-μ------')"
    return f"trim(regexp_replace({out}, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


_MARKED_SQL = "coalesce(text, '') || CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {_q(m)}" for i, m in enumerate(_MARKUP)) + " END"


@registry.add(f"SELECT doc_id, {_plain_sql(_MARKED_SQL)} AS plain FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plain form of every text with LaTeX, tags, entities, signs and odd spaces put behind it."""
    d = spread(table(spark, sf_dir, "documents"))
    tail = F.element_at(F.array(*map(F.lit, _MARKUP)), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.select("doc_id", T.normalize_markup(F.concat(F.coalesce("text", F.lit("")), tail)).alias("plain"))


@registry.add(f"WITH t AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, substr(coalesce(text, ''), length(split_part(coalesce(text, ''), chr(10), 1)) + 2) AS abstract FROM documents) SELECT doc_id, {_plain_sql('title')} AS title, {_plain_sql(chr(116) + 'itle || ' + _q('. ') + ' || abstract')} AS whole FROM t")
def record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plain title (the first line), and 'title. abstract'."""
    text = F.coalesce("text", F.lit(""))
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.split_part(text, F.lit("\n"), F.lit(1)).alias("title"), text.alias("text"))
    return d.select("doc_id", T.normalize_markup(F.col("title")).alias("title"), T.record_text(F.col("title"), F.substr("text", F.length("title") + 2)).alias("whole"))


@registry.add("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^<>]*>', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS plain FROM pages")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text of a page without its tags."""
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"))


@registry.add("SELECT page_id, trim(regexp_replace(lower(strip_accents(url)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM pages")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-name form of a URL."""
    return table(spark, sf_dir, "pages").select("page_id", T.slugify(F.col("url")).alias("slug"))


@registry.add("SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce(text, '')), '\\\\[a-zA-Z]+|\\$', ' ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents")
def title_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form in which titles are compared: no accents, commands or punctuation."""
    return spread(table(spark, sf_dir, "documents")).select("doc_id", T.title_identity(F.col("text")).alias("norm"))


@registry.add("SELECT page_id, trim(regexp_replace(lower(regexp_replace(regexp_replace(html, '&(quot|amp|copy|middot);?', ' ', 'g'), '<[^>]+>', ' ', 'g')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS form FROM pages")
def title_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, the second form: tags and entities off, letters of any script kept."""
    return spread(table(spark, sf_dir, "pages")).select("page_id", T.title_form(F.col("html")).alias("form"))


_RAWS = ("'ARXIV:2401.' || lpad(page_id::VARCHAR, 5, '0') || 'v2).'", "'DOI:10.1000/ABC.' || page_id::VARCHAR || ','", "'`Hal:hal-X' || page_id::VARCHAR || '`'", "'osti:' || page_id::VARCHAR || ';'", "'foo:ABC' || page_id::VARCHAR", "'no prefix ' || page_id::VARCHAR")
_RAW = "CASE page_id % 6 " + " ".join(f"WHEN {i} THEN {r}" for i, r in enumerate(_RAWS)) + " END"


def raw_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id").cast("string")
    forms = [("ARXIV:2401.", F.lpad(n, 5, "0"), "v2)."), ("DOI:10.1000/ABC.", n, ","), ("`Hal:hal-X", n, "`"), ("osti:", n, ";"), ("foo:ABC", n, ""), ("no prefix ", n, "")]
    raw = F.element_at(F.array(*[F.concat(F.lit(a), b, F.lit(c)) for a, b, c in forms]), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", raw.alias("raw"))


@registry.add(
    f"""WITH r AS (SELECT page_id, ltrim(rtrim(trim({_RAW}), ').,;]|`'), '`') AS b FROM pages), s AS (SELECT page_id, CASE WHEN contains(b, ':') THEN lower(split_part(b, ':', 1)) END AS p, substr(b, strpos(b, ':') + 1) AS v FROM r)
SELECT page_id, CASE WHEN p = 'arxiv' THEN 'arxiv:' || regexp_replace(v, '(?i)v\\d+$', '') WHEN p IN ('doi', 'hal', 'osti') THEN p || ':' || lower(v) END AS id FROM s"""
)
def canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: identifiers in their canonical form; null for unknown kinds."""
    return raw_ids(spark, sf_dir).select("page_id", T.canonical_id(F.col("raw")).alias("id"))


_LINKED = "[CASE page_id % 5 WHEN 0 THEN 'https://arxiv.org/abs/2309.' || lpad((page_id % 9999)::VARCHAR, 5, '0') || 'v3' WHEN 1 THEN '10.48550/arXiv.2310.01234' WHEN 2 THEN 'cond-mat/9901' || lpad((page_id % 1000)::VARCHAR, 3, '0') ELSE '10.1103/PhysRev' END, '10.5281/zenodo.77']"


@registry.add(
    f"""WITH r AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '2309.' || lpad((page_id % 9999)::VARCHAR, 5, '0') WHEN 1 THEN '2310.01234' WHEN 2 THEN 'cond-mat/9901' || lpad((page_id % 1000)::VARCHAR, 3, '0') WHEN 3 THEN '2412.00007' END AS id FROM pages)
SELECT page_id, id, coalesce(id LIKE '23__.%', false) AS in_range FROM r"""
)
def arxiv_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number that related identifiers, or else the abstract, name; and is it of the years 2023?"""
    n = F.col("page_id")
    form = F.when(n % 5 == 0, F.concat(F.lit("https://arxiv.org/abs/2309."), F.lpad((n % 9999).cast("string"), 5, "0"), F.lit("v3"))).when(n % 5 == 1, "10.48550/arXiv.2310.01234").when(n % 5 == 2, F.concat(F.lit("cond-mat/9901"), F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise("10.1103/PhysRev")
    abstract = F.when(n % 5 == 3, "as shown in arXiv:2412.00007v2, we")
    found = table(spark, sf_dir, "pages").select("page_id", T.arxiv_of_record(F.array(form, F.lit("10.5281/zenodo.77")), abstract).alias("id"))
    return found.select("page_id", "id", (F.size(T.ids_between(F.array(F.coalesce("id", F.lit(""))), 2300, 2399)) > 0).alias("in_range"))


@registry.add("WITH d AS (SELECT page_id, '10.1/x' || (page_id // 3)::VARCHAR || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '/v1' ELSE '.v2' END AS doi FROM pages) SELECT page_id, CASE WHEN regexp_matches(doi, '^(.*)([/.\\-])v(\\d+)$') THEN regexp_extract(doi, '^(.*)([/.\\-])v(\\d+)$', 1) ELSE doi END AS base, CASE WHEN regexp_matches(doi, '^(.*)([/.\\-])v(\\d+)$') THEN regexp_extract(doi, '^(.*)([/.\\-])v(\\d+)$', 3)::INT END AS number, CASE WHEN regexp_matches(doi, '^(.*)([/.\\-])v(\\d+)$') THEN regexp_extract(doi, '^(.*)([/.\\-])v(\\d+)$', 2) END AS separator FROM d")
def split_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """base, number and separator of a versioned id."""
    p = F.col("page_id")
    doi = F.concat(F.lit("10.1/x"), F.floor(p / 3).cast("string"), F.when(p % 3 == 0, "").when(p % 3 == 1, "/v1").otherwise(".v2"))
    return table(spark, sf_dir, "pages").select("page_id", T.split_version(doi).alias("v")).select("page_id", "v.*")


@registry.add("SELECT page_id, 'url:' || regexp_replace(trim(url), '/+$', '') AS identity FROM pages")
def identity_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one spelling for each thing."""
    return table(spark, sf_dir, "pages").select("page_id", T.identity(F.lit("url"), F.col("url")).alias("identity"))


@registry.add("SELECT c_custkey, trim(substr(lower(strip_accents(c_name)), 1, 1) || ' ' || list_last(regexp_split_to_array(trim(replace(lower(strip_accents(c_name)), '.', ' ')), '\\s+'))) AS person FROM customer")
def person_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """initial and last name."""
    return table(spark, sf_dir, "customer").select("c_custkey", T.person_key(F.col("c_name")).alias("person"))


@registry.add("WITH n AS (SELECT s_nationkey, list(s_name ORDER BY s_name) AS names FROM supplier GROUP BY 1) SELECT s_nationkey, array_to_string(names[1:3], ', ') || CASE WHEN len(names) > 3 THEN ' et al.' ELSE '' END AS authors FROM n")
def short_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first three names, and 'et al.'."""
    n = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("names"))
    return n.select("s_nationkey", T.short_authors(F.col("names")).alias("authors"))


@registry.add("WITH d AS (SELECT o_orderkey, [year(o_orderdate), CASE WHEN o_orderkey % 3 > 0 THEN month(o_orderdate) END, CASE WHEN o_orderkey % 3 = 2 THEN day(o_orderdate) END] AS p FROM orders) SELECT o_orderkey, make_date(p[1], coalesce(p[2], 1), coalesce(p[3], 1)) AS day FROM d")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dates from year, month and day, of which the last ones may be missing."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    parts = F.array(F.year(d), F.when(k % 3 > 0, F.month(d)), F.when(k % 3 == 2, F.dayofmonth(d)))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.date_from_parts(parts).alias("day"))


_CITING = "text || ' see arXiv:2401.' || lpad((conv_id % 50)::VARCHAR, 5, '0') || 'v' || (turn + 1)::VARCHAR || ', DOI:10.1000/ABC.' || (turn % 3)::VARCHAR || '. and (HAL:hal-77) osti:' || (conv_id % 4)::VARCHAR || '; [@k' || (turn % 2)::VARCHAR || '; @z:1/x-' || (conv_id % 3)::VARCHAR || '] [@k0]'"


def _citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, v, t = table(spark, sf_dir, "conversations"), F.col("conv_id"), F.col("turn")
    text = F.concat("text", F.lit(" see arXiv:2401."), F.lpad((v % 50).cast("string"), 5, "0"), F.lit("v"), (t + 1).cast("string"), F.lit(", DOI:10.1000/ABC."), (t % 3).cast("string"), F.lit(". and (HAL:hal-77) osti:"), (v % 4).cast("string"), F.lit("; [@k"), (t % 2).cast("string"), F.lit("; @z:1/x-"), (v % 3).cast("string"), F.lit("] [@k0]"))
    return c.select("conv_id", "turn", text.alias("text"))


@registry.add(
    f"""WITH c AS (SELECT conv_id, turn, regexp_extract_all({_CITING}, '(?i)\\b(?:arXiv:\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?|doi:10\\.\\d{{4,9}}/[^\\s`<>"''\\]|]+|hal:hal-\\d+|osti:\\d+)') AS found FROM conversations),
e AS (SELECT conv_id, lower(rtrim(unnest(found), ').,;]|`')) AS raw FROM c), n AS (SELECT conv_id, CASE WHEN raw LIKE 'arxiv:%' THEN regexp_replace(raw, 'v\\d+$', '') ELSE raw END AS id FROM e)
SELECT conv_id, count(DISTINCT id) AS ids, count(DISTINCT id) FILTER (id LIKE 'doi:%') AS dois, min(id) AS least FROM n GROUP BY 1"""
)
def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifiers of the four kinds that each conversation cites."""
    e = _citing(spark, sf_dir).select("conv_id", F.explode(T.citations(F.col("text"))).alias("id"))
    return e.groupBy("conv_id").agg(F.count_distinct("id").alias("ids"), F.count_distinct(F.when(F.col("id").startswith("doi:"), F.col("id"))).alias("dois"), F.min("id").alias("least"))


@registry.add(f"SELECT key, count(*) AS mentions, count(DISTINCT conv_id) AS conversations FROM (SELECT conv_id, unnest(regexp_extract_all(g, '@([\\w:./-]+)', 1)) AS key FROM (SELECT conv_id, unnest(regexp_extract_all({_CITING}, '\\[\\s*@[\\w:./-]+(?:\\s*;\\s*@[\\w:./-]+)*\\s*\\]')) AS g FROM conversations)) GROUP BY 1")
def citation_group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys of the citation groups, and in how many conversations each is."""
    e = _citing(spark, sf_dir).select("conv_id", F.explode(T.citation_groups(F.col("text"))).alias("key"))
    return e.groupBy("key").agg(F.count("*").alias("mentions"), F.count_distinct("conv_id").alias("conversations"))


@registry.add(
    """WITH m AS (SELECT conv_id, turn, regexp_extract_all(text, '(^|[^A-Za-z])([A-Z][a-z]{5,})', 2) AS keys FROM conversations), e AS (SELECT conv_id, turn, unnest(range(0, len(keys))) AS i, unnest(keys) AS key FROM m),
f AS (SELECT conv_id, key, min(turn * 1000000 + i) AS first, count(*) AS mentions FROM e GROUP BY ALL) SELECT conv_id, key, first, mentions, dense_rank() OVER (PARTITION BY conv_id ORDER BY first, key)::INT AS number FROM f"""
)
def citation_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys numbered by first mention within each conversation."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit("(^|[^A-Za-z])([A-Z][a-z]{5,})"), F.lit(2))).alias("i", "key"))
    return M.numbered(m.withColumn("position", F.col("turn") * 1000000 + F.col("i")), "conv_id", "position", "key")


@registry.add("WITH m AS (SELECT conv_id, '## ' || role || chr(10) || '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || turn::VARCHAR || ' | **' || length(text)::VARCHAR || '** |' AS md FROM conversations) SELECT conv_id, count(*) AS tables, count(DISTINCT split_part(split_part(md, chr(10), 1), ' ', 2)) AS headings, sum(regexp_extract(md, '\\*\\*(\\d+)\\*\\*', 1)::BIGINT)::BIGINT AS chars FROM m GROUP BY 1")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """headings and table cells of Markdown text."""
    c = table(spark, sf_dir, "conversations")
    md = F.concat(F.lit("## "), "role", F.lit("\n| a | b |\n|---|:-:|\n| "), F.col("turn").cast("string"), F.lit(" | **"), F.length("text").cast("string"), F.lit("** |"))
    rows = c.select("conv_id", F.explode(M.sections(md)).alias("part")).select("conv_id", F.regexp_extract("part", r"^## (\S+)", 1).alias("heading"), F.element_at(M.table_rows(F.col("part")), -1).alias("cells"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("tables"), F.count_distinct("heading").alias("headings"), F.sum(M.strip_markdown(F.col("cells")[1]).cast("long")).alias("chars"))


@registry.add("SELECT c_nationkey AS nation, 'Segment ' || c_mktsegment AS name, lower(c_mktsegment) AS key, count(*) AS n, 0.5::DOUBLE AS low, 1.0 + c_nationkey / 4 AS high, 'a_b of ' || c_nationkey::VARCHAR AS note, 2 AS caveats FROM customer GROUP BY c_nationkey, c_mktsegment")
def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a report's sections, labelled lines, bullets and tables, with named, interval and count cells."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    row = F.concat(F.lit("| **Segment "), "segment", F.lit("** ("), F.lower("segment"), F.lit(") | "), F.format_number("n", 0), F.lit(" | 0.50-"), F.format_string("%.2f", 1 + F.col("nation") / 4), F.lit(" |"))
    text = F.concat(F.lit("# T\n\n## Q1 counts\n**Note:** `a_b` of "), F.col("nation").cast("string"), F.lit("\n\n- one **two**\n* three\n\n| Other | x |\n|---|---|\n| y | z |\n\n| Cluster | Count | 95% CI |\n|---|:-:|---:|\n"), F.array_join(F.array_sort(F.collect_list(row)), "\n"), F.lit("\n\n## Q2 rest\n| Cluster | Count | 95% CI |\n|---|---|---|\n| no | 1 | 2-3 |\n"))
    q1 = c.groupBy("nation").agg(text.alias("text")).select("nation", F.explode(F.array(M.section(F.col("text"), "Q1"))).alias("q1"))
    rows = q1.select("nation", M.labelled_line(F.col("q1"), "Note").alias("note"), F.size(M.bullets(F.col("q1"))).alias("caveats"), F.explode(M.table_records(F.col("q1"), "Cluster")).alias("r"))
    named, interval = M.named_cell(F.col("r")["Cluster"]), M.interval_cell(F.col("r")["95% CI"])
    return rows.select("nation", named["name"].alias("name"), named["key"].alias("key"), M.count_cell(F.col("r")["Count"]).alias("n"), interval["low"].alias("low"), interval["high"].alias("high"), "note", "caveats")


@registry.add("SELECT user_id, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, count(DISTINCT json_extract_string(props, '$.k')) AS kinds FROM events GROUP BY 1")
def json_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON text, null where they are missing."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.count_distinct(k).alias("kinds"))


_STRONG, _WEAK, _HEDGE, _CUE, _RELIABLE, _THEORY = r"\b[Ll]icen[sc]e", r"\bCopyright\b", r"\b(not|may|could|the)\b", r"[Vv]ersion", r"@", r"[Rr]ights"


def _unhedged_sql(text: str, pattern: str) -> str:
    """Matches with no hedge in the 80 characters before them: the text up to a match is put together from the parts
    between matches."""
    parts, found = f"regexp_split_to_array({text}, '{pattern}')", f"regexp_extract_all({text}, '{pattern}')"
    before = f"right(array_to_string(list_transform(range(1, i + 1), lambda j: ({parts})[j] || CASE WHEN j < i THEN ({found})[j] ELSE '' END), ''), 80)"
    return f"len(list_filter(range(1, len({found}) + 1), lambda i: NOT regexp_matches({before}, '{_HEDGE}')))"


_RULE_TEXT = "coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' License. Not Copyright, Copyright; Version' WHEN 1 THEN ' not Copyright, and not Copyright Version' WHEN 2 THEN repeat(' filler', 20) || ' Copyright' || repeat(' filler', 20) || ' Copyright Rights' ELSE ' not a License' END"


@registry.add(
    f"""WITH t AS (SELECT doc_id, {_RULE_TEXT} AS t FROM documents), h AS (SELECT doc_id, {_unhedged_sql("t", _STRONG)} AS strong_hits, {_unhedged_sql("t", _WEAK)} AS weak_hits, regexp_matches(t, '{_CUE}') OR regexp_matches(t, '{_RELIABLE}') OR NOT regexp_matches(t, '{_THEORY}') AS in_context FROM t)
SELECT doc_id, strong_hits::INT AS strong_hits, weak_hits::INT AS weak_hits, in_context, strong_hits > 0 OR (in_context AND weak_hits >= 2) AS matched FROM h"""
)
def hedged_match_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that no hedge word precedes, contexts by cue, by reliable probe or by no theory, and the two-tier
    rule."""
    rule = E.TwoTier(_STRONG, _WEAK, _CUE, _HEDGE, 2, (_RELIABLE,), _THEORY)
    filler = " filler" * 20
    tails = (" License. Not Copyright, Copyright; Version", " not Copyright, and not Copyright Version", f"{filler} Copyright{filler} Copyright Rights", " not a License")
    text = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, tails)), (F.col("doc_id") % 4 + 1).cast("int")))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", E.two_tier(text, rule).alias("r")).select("doc_id", "r.*")


_FORMULAS = ("La3Ni2O7-δ and 1T-TaSe2, not THST2 or Q4Zz; Sr2RuO4-x films", "MnTe2 on SiO2, BICs, CuO2 planes and NiAs-type MnTe", "SrCu2(BO3)2 under La0.7Sr0.3MnO3; SC2024, SU2")
_FOUND = ("La3Ni2O7,TaSe2,Sr2RuO4", "MnTe2,MnTe", "La0.7Sr0.3MnO3")


def with_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(F.array(*map(F.lit, _FORMULAS)), (F.col("doc_id") % 3 + 1).cast("int")))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", E.formulas(text).alias("formulas"))


@registry.add("SELECT doc_id, CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FOUND)) + " END AS formulas FROM documents")
def token_formula_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chemical formulas of real elements, without generic ones, acronyms, units, structure types and pieces of
    parenthesised ones; the prose has none of its own."""
    return with_formulas(spark, sf_dir).select("doc_id", F.array_join("formulas", ",").alias("formulas"))


_FIRST, _SECOND = ("La", "Sr", "Mn", "Cu", "Zz", "H"), ("O", "Te", "Se", "Q", "C")
_COUNTS, _LAST = ("", "2", "0.7", "123"), ("3", "", "-x", "4")
_AROUND = (("(", ")"), ("", "-type"), ("", "-structured"), ("1T-", ""), ("", ","), ("x", ""), ("", " and"))
_SQL_LIST = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
_PARTS_SQL = f"""c AS (SELECT p_partkey AS k, ({_SQL_LIST(_FIRST)})[1 + p_partkey % 6] AS a, ({_SQL_LIST(_COUNTS)})[1 + p_partkey % 4] AS i, ({_SQL_LIST(_SECOND)})[1 + p_partkey % 5] AS b, ({_SQL_LIST(_LAST)})[1 + p_partkey // 4 % 4] AS j, p_partkey % 7 AS around FROM part),
d AS (SELECT *, a || i || b || CASE WHEN j = '-x' THEN '' ELSE j END AS body FROM c),
v AS (SELECT *, CASE WHEN around IN (0, 1, 2, 5) THEN 'context' WHEN body IN ('H2O', 'SiO2') THEN 'generic' WHEN i = '' AND b = 'O' AND (j = '3' OR j = '4') THEN 'unit'
    WHEN a = 'Zz' OR b = 'Q' THEN 'element' WHEN i = '123' THEN 'count' WHEN i = '' AND j NOT IN ('3', '4') AND length(a) < 2 AND length(b) < 2 THEN 'letters' ELSE 'formula' END AS verdict FROM d)"""


def _part_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each part that names a compound made of its number: symbols, counts and what stands around it differ."""
    k = F.col("p_partkey")
    of = lambda items, at: F.element_at(F.array(*map(F.lit, items)), (1 + at).cast("int"))
    body = F.concat(of(_FIRST, k % 6), of(_COUNTS, k % 4), of(_SECOND, k % 5), of(_LAST, F.floor(k / 4) % 4))
    before, after = (of([x[i] for x in _AROUND], k % 7) for i in (0, 1))
    return table(spark, sf_dir, "part").select(k.alias("k"), F.concat(F.lit("Films on SiO2, BICs: "), before, body, after, F.lit(" grown by CP1, p."), k.cast("string")).alias("t"))


@registry.add(f"WITH {_PARTS_SQL} SELECT body AS formula, count(*) AS n, min(k) AS first FROM v WHERE verdict = 'formula' GROUP BY 1")
def formula_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """formulas of all parts' sentences with their counts; what is rejected is left out."""
    found = _part_texts(spark, sf_dir).select("k", F.explode(E.formulas(F.col("t"))).alias("formula"))
    return found.groupBy("formula").agg(F.count("*").alias("n"), F.min("k").alias("first"))


@registry.add(
    f"WITH {_PARTS_SQL}, x AS (SELECT k, verdict FROM v WHERE around <> 5 UNION ALL SELECT k, unnest(['generic', 'acronym', 'plural']) FROM v) SELECT verdict, count(*) AS n, sum(k)::BIGINT AS checksum FROM x GROUP BY 1"
)
def formula_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate of all parts' sentences with why it is none: where it stands, generic, acronym, plural, a unit of
    structure, a symbol that is no element, a count of three digits, or single letters alone."""
    found = _part_texts(spark, sf_dir).select("k", F.explode(E.formula_verdicts(F.col("t"))).alias("verdict"))
    return found.groupBy("verdict").agg(F.count("*").alias("n"), F.sum("k").alias("checksum"))


#: Own families for the samples; base families first, then what extends them.
FAMILIES = (("nickelates", L.formula_group(["La3Ni2O7", r"La4Ni3O10"])), ("manganites", L.formula_group([r"La0\.\d+Sr0\.\d+MnO3"])))
MORE_FAMILIES = (("dichalcogenides", L.join(L.formula_group(["TaSe2", "MoTe2"]), L.ci(r"\bdichalcogenides?\b"))),)


@registry.add("WITH f AS (SELECT unnest(string_split(CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FOUND)) + " END, ',')) AS formula FROM documents) SELECT formula, count(*) AS n FROM f WHERE formula IN ('Sr2RuO4', 'MnTe2', 'MnTe') GROUP BY 1")
def uncovered_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas that no base or extended family names, with their counts."""
    counts = with_formulas(spark, sf_dir).select(F.explode("formulas").alias("formula")).groupBy("formula").agg(F.count("*").alias("n"))
    covered = F.lit(False)
    for _, pattern in FAMILIES + MORE_FAMILIES:
        covered = covered | F.col("formula").rlike(pattern)
    return counts.where(~covered)


@registry.add()
def sequence_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a document's first line match its second, by sequence ratio or word prefix?"""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return spread(table(spark, sf_dir, "documents")).select("doc_id", E.titles_match(lines[0], F.coalesce(F.try_element_at(lines, F.lit(2)), F.lit(""))).alias("same"))


@registry.add()
def title_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other titles of the whole table that are a title's own up to small changes or a cut end."""
    title = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)).alias("title")
    rows = spread(table(spark, sf_dir, "documents")).select("doc_id", title)
    return sequences.sequence_matches(rows, rows, "doc_id", "title", others=True)


_BIGRAM_STOP = ["the", "of", "and", "in", "to", "for", "with", "on", "by"]


@registry.add(
    f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(split_part({_plain_sql("coalesce(text, '')")}, '. ', 1)), '[a-z][a-z0-9''-]+'), lambda t: NOT list_contains([{', '.join(f"'{x}'" for x in _BIGRAM_STOP)}], t)) AS k FROM documents),
b AS (SELECT unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) AS bigram FROM w WHERE len(k) > 1) SELECT bigram, count(*) AS n FROM b GROUP BY 1 HAVING count(*) >= 2"""
)
def title_bigrams_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, the second variant: bigrams of the normalised title (the first sentence), repeats counted."""
    title = F.lower(F.split_part(T.normalize_markup(F.col("text")), F.lit(". "), F.lit(1)))
    tokens = F.regexp_extract_all(title, F.lit("[a-z][a-z0-9'-]+"), F.lit(0))
    b = spread(table(spark, sf_dir, "documents")).select(F.explode(T.bigrams(tokens, _BIGRAM_STOP)).alias("bigram"))
    return b.groupBy("bigram").agg(F.count("*").alias("n")).where("n >= 2")


@registry.add(
    r"""WITH s AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' [ORCID:0000-' || s_suppkey::VARCHAR || ']' WHEN s_suppkey % 3 = 1 THEN 'S. ' || replace(s_name, '#', '') || ' (ORCID 1)' ELSE s_name || ' [CERN, Geneva]' END AS raw FROM supplier)
SELECT s_suppkey, trim(regexp_replace(regexp_replace(raw, '\s*[\[(](?i:orcid)[^\])]*[\])]', ''), '\s*\[[^\]]*\]\s*$', '')) AS name FROM s"""
)
def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names from given and family parts, ORCID and affiliation tails off."""
    k = F.col("s_suppkey")
    plain = T.author_names(F.when(k % 3 == 1, "S."), F.when(k % 3 == 1, F.replace("s_name", F.lit("#"), F.lit(""))), F.col("s_name"))
    tail = F.when(k % 3 == 0, F.concat(F.lit(" [ORCID:0000-"), k.cast("string"), F.lit("]"))).when(k % 3 == 1, " (ORCID 1)").otherwise(" [CERN, Geneva]")
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.bare_author(F.concat(plain, tail)).alias("name"))
