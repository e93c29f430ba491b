"""Rule-set labels over documents: counts, co-occurrence, evidence, bigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phrases
from ..functions import rules as L
from ..functions import stats
from ..functions import text as T
from ..operators import ranking
from .common import Registry, r6, scratch, spread, table

registry = Registry()

#: Own rules for the synthetic prose; portable between regular expression dialects.
LABELS = L.RuleSet(
    (
        L.Rule("licensing", r"[Ll]icen[sc]e", kind="form"),
        L.Rule("contact", r"[A-Za-z0-9._]+@[A-Za-z0-9]+\.[a-z]+", kind="form"),
        L.Rule("shouting", r"[A-Z]{3,}!!", exclude=r"[Ll]icen[sc]e", kind="style"),
        L.Rule("columns", r" \| ", kind="style"),
        L.Rule("symbols", r"[#$%&*]{3}", kind="style"),
        L.Rule("insults", r"(^|[^A-Za-z])(moron|stupid|trash|disgusting)([^A-Za-z]|$)", kind="tone"),
        L.Rule("german", r"(^|[^\p{L}])(der|die|und)([^\p{L}]|$)", residual=True),
        L.Rule("romance", r"(^|[^\p{L}])(les|que|los)([^\p{L}]|$)", residual=True),
        L.Rule("english", r"(^|[^\p{L}])(the|of|and)([^\p{L}]|$)", residual=True),
    )
)
SCOPE = (("legal", r"Copyright|[Ll]icen[sc]e", None), ("common", r"(^|[^A-Za-z])the([^A-Za-z]|$)", r"[#$%&*]{3}"), ("mail", r"@", r" \| "))
CATEGORY_SOURCES = ("src1", "src2", "src3")
STOP = ["the", "of", "and", "to", "in", "a", "is", "de", "la", "que", "les", "der", "die", "und", "des"]


def q(p: str) -> str:
    return p.replace("'", "''")


def _hit(p: str, text: str = "text") -> str:
    return f"regexp_matches({text}, '{q(p)}')"


def _labels_sql() -> str:
    regular = ", ".join(f"CASE WHEN {_hit(r.pattern)}{f' AND NOT {_hit(r.exclude)}' if r.exclude else ''} THEN '{r.key}' END" for r in LABELS.rules if not r.residual)
    rest = " ".join(f"WHEN {_hit(r.pattern)} THEN '{r.key}'" for r in LABELS.rules if r.residual)
    return f"""l0 AS (SELECT doc_id, lang, source, n_chars, coalesce(text, '') AS text FROM documents),
l1 AS (SELECT *, list_filter([{regular}], lambda x: x IS NOT NULL) AS regular, CASE {rest} END AS rest FROM l0),
l AS (SELECT doc_id, lang, source, n_chars, CASE WHEN len(regular) > 0 THEN regular WHEN rest IS NOT NULL THEN [rest] ELSE [] END AS labels FROM l1),
x AS (SELECT doc_id, lang, source, unnest(CASE WHEN len(labels) = 0 THEN ['unclassified'] ELSE labels END) AS label FROM l)"""


_L = "WITH " + _labels_sql()


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).withColumn("text", F.coalesce("text", F.lit("")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table.  Texts end here: explode() of one item keeps later operators from copying the patterns into
    themselves, so each runs once a text."""
    return docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", F.explode(F.array(LABELS.labels(F.col("text")))).alias("labels"))


def exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select("doc_id", "lang", "source", F.explode(L.or_unclassified(F.col("labels"))).alias("label"))


@registry.add(f"{_L} SELECT label, count(*) AS n, count(DISTINCT source) AS sources FROM x GROUP BY 1")
def multilabel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each label; a document counts for all of its labels."""
    return exploded(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@registry.add(f"{_L} SELECT coalesce(labels[1], 'unclassified') AS label, count(*) AS n FROM l GROUP BY 1")
def primary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by first label."""
    return labelled(spark, sf_dir).groupBy(F.coalesce(L.primary(F.col("labels")), F.lit("unclassified")).alias("label")).agg(F.count("*").alias("n"))


@registry.add(f"{_L} SELECT doc_id, source IN ('src1', 'src2', 'src3') AS in_scope, CASE WHEN source IN ('src1', 'src2', 'src3') THEN array_to_string(labels, ',') ELSE '' END AS labels, CASE WHEN source IN ('src1', 'src2', 'src3') THEN labels[1] END AS primary_label FROM l")
def classified_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the classification struct; out of scope, empty labels and no primary one."""
    scope = F.col("source").isin(*CATEGORY_SOURCES)
    x = labelled(spark, sf_dir).withColumn("in_scope", scope)
    return x.select("doc_id", "in_scope", F.when(F.col("in_scope"), F.array_join("labels", ",")).otherwise("").alias("labels"), F.when(F.col("in_scope"), L.primary(F.col("labels"))).alias("primary_label"))


_EV = r"[Ll]icen[sc]e"


@registry.add(f"SELECT source, count(*) FILTER ({_hit(_EV, 'split_part(text, chr(10), 1)')}) AS in_title, count(*) FILTER ({_hit(_EV, 'split_part(text, chr(10), 1)')} OR len(regexp_extract_all(text, '{_EV}')) >= 2) AS with_evidence, count(*) FILTER ({_hit(_EV)}) AS any_hit FROM documents GROUP BY 1")
def evidence_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit in the first line, or two anywhere."""
    d = docs(spark, sf_dir)
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return d.groupBy("source").agg(F.count_if(title.rlike(_EV)).alias("in_title"), F.count_if(L.evidence(F.col("text"), title, _EV)).alias("with_evidence"), F.count_if(F.col("text").rlike(_EV)).alias("any_hit"))


def _hits(text):
    return F.array_compact(F.array(*[F.when(text.rlike(p) & (~text.rlike(v) if v else F.lit(True)), n) for n, p, v in SCOPE]))


_HITS = "list_filter([" + ", ".join(f"CASE WHEN {_hit(p)}{f' AND NOT {_hit(v)}' if v else ''} THEN '{n}' END" for n, p, v in SCOPE) + "], lambda x: x IS NOT NULL)"


@registry.add(f"SELECT doc_id, array_to_string({_HITS}, ',') AS hits FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def scope_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: scope words, each with the context that vetoes it."""
    return docs(spark, sf_dir).select("doc_id", F.array_join(_hits(F.col("text")), ",").alias("hits"))


@registry.add(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'category' WHEN len({_HITS}) > 0 THEN 'keyword' ELSE 'none' END AS reason FROM (SELECT source, coalesce(text, '') AS text FROM documents)) GROUP BY 1")
def scope_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In scope by category, else by keyword; the keyword patterns run for other rows only."""
    reason = F.when(F.col("source").isin(*CATEGORY_SOURCES), "category").when(F.size(_hits(F.col("text"))) > 0, "keyword").otherwise("none")
    return docs(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@registry.add(f"{_L}, s AS (SELECT label, count(*) AS n FROM x GROUP BY 1), p AS (SELECT a.label AS a, b.label AS b, count(*) AS n_ab FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.label < b.label GROUP BY ALL) SELECT p.a, p.b, n_ab, sa.n AS n_a, sb.n AS n_b, round(n_ab * (SELECT count(*) FROM l) / (sa.n * sb.n), 6) AS lift, round(n_ab / sa.n, 6) AS confidence FROM p JOIN s sa ON sa.label = p.a JOIN s sb ON sb.label = p.b")
def cooccurrence_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of labels on one document.  Pairs are made inside a row from its few labels, without a join."""
    x = labelled(spark, sf_dir).select(F.array_sort(L.or_unclassified(F.col("labels"))).alias("labels"))
    pairs = F.flatten(F.transform("labels", lambda a: F.transform(F.filter("labels", lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    singles = F.transform("labels", lambda a: F.struct(a.alias("a"), F.lit(None).cast("string").alias("b")))
    total = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    counts = x.select(F.explode(F.concat(total, singles, pairs)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    # A row a label or pair is left, so one row can hold them all: the label table is read once, and nothing is joined.
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    held = counts.agg(F.map_from_entries(F.collect_list(F.when(a.isNotNull() & b.isNull(), F.struct("a", "n")))).alias("one"), F.max(F.when(a.isNull(), n)).alias("total"), F.collect_list(F.when(b.isNotNull(), F.struct("a", "b", "n"))).alias("pairs"))
    both = held.select("one", "total", F.explode("pairs").alias("p")).select("p.a", "p.b", F.col("p.n").alias("n_ab"), F.col("one")[F.col("p.a")].alias("n_a"), F.col("one")[F.col("p.b")].alias("n_b"), "total")
    n_ab, n_a, n_b = F.col("n_ab"), F.col("n_a"), F.col("n_b")
    return both.select("a", "b", "n_ab", "n_a", "n_b", r6(stats.lift(n_ab, n_a, n_b, F.col("total"))).alias("lift"), r6(n_ab / n_a).alias("confidence"))


_FORM, _STYLE = "['licensing', 'contact']", "['shouting', 'columns', 'symbols']"


@registry.add(f"{_L} SELECT source, count(*) AS n, count(*) FILTER (list_has_any(labels, {_FORM})) AS any_form, count(*) FILTER (list_has_any(labels, {_STYLE})) AS any_style, count(*) FILTER (list_has_any(labels, {_FORM}) AND list_has_any(labels, {_STYLE})) AS both, count(*) FILTER (NOT list_has_any(labels, {_FORM}) AND NOT list_has_any(labels, {_STYLE})) AS neither, sum(len(labels))::BIGINT AS mentions FROM l GROUP BY 1")
def kind_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels of either kind, both or none, and label mentions."""
    form, style = (F.arrays_overlap("labels", F.array(*map(F.lit, LABELS.of_kind(k)))) for k in ("form", "style"))
    return labelled(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(form).alias("any_form"), F.count_if(style).alias("any_style"), F.count_if(form & style).alias("both"), F.count_if(~form & ~style).alias("neither"), F.sum(F.size("labels")).alias("mentions"))


@registry.add(f"{_L}, c AS (SELECT source, label, count(*) AS n FROM x GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, label) AS rank, sum(n) OVER (PARTITION BY source) AS total FROM c) SELECT source, label, n, rank::INT AS rank, round(n / total, 6) AS share FROM r WHERE rank <= 3")
def top_labels_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three commonest labels of each source."""
    c = exploded(spark, sf_dir).groupBy("source", "label").agg(F.count("*").alias("n"))
    c = c.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("source"))))
    return ranking.top_per_group(c, ["source"], [F.desc("n"), F.col("label")], 3).select("source", "label", "n", "rank", "share")


@registry.add(f"{_L}, g AS (SELECT s.source, k.label FROM (SELECT DISTINCT source FROM l) s CROSS JOIN (SELECT DISTINCT label FROM x) k), c AS (SELECT source, label, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT source, count(*) AS total FROM l GROUP BY 1) SELECT g.source, g.label, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 3) AS share FROM g LEFT JOIN c ON g.source IS NOT DISTINCT FROM c.source AND g.label = c.label JOIN t ON g.source IS NOT DISTINCT FROM t.source")
def family_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label in every source, zeros included."""
    x = exploded(spark, sf_dir)
    c = x.groupBy("source", "label").agg(F.count("*").alias("n"))
    t = labelled(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total"))
    grid = t.crossJoin(c.select("label").distinct())  # sources x labels
    on = grid["source"].eqNullSafe(c["source"]) & (grid["label"] == c["label"])
    return grid.join(c, on, "left").select(grid["source"], grid["label"], F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("n", F.lit(0)) / F.col("total"), 3).alias("share"))


_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_BI = f"""WITH w AS (SELECT doc_id, source, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda t: len(t) >= 2 AND NOT list_contains({_STOP}, t)) AS k FROM documents),
b AS (SELECT doc_id, source, unnest(list_distinct(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1]))) AS bigram FROM w WHERE len(k) > 1)"""


def _bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return docs(spark, sf_dir).select("doc_id", "source", F.explode(F.array_distinct(T.bigrams(tokens, STOP))).alias("bigram"))


@registry.add(f"{_BI} SELECT bigram, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, bigram LIMIT 20")
def title_bigrams_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest bigrams by document frequency."""
    return _bigrams(spark, sf_dir).groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(20)


_CHAR = f"{_BI}, c AS (SELECT bigram, count(*) FILTER (source = 'src0') AS c_n, count(*) FILTER (source <> 'src0') AS c_d FROM b GROUP BY 1), t AS (SELECT count(*) FILTER (source = 'src0') AS n, count(*) FILTER (source <> 'src0') AS d FROM b), s AS (SELECT bigram, c_n, c_d, round(((c_n + 1) / (n + 1)) / ((c_d + 1) / (d + 1)), 6) AS score FROM c, t WHERE c_n >= 4) SELECT * FROM s ORDER BY score DESC, c_n DESC, bigram DESC LIMIT 15"


@registry.add(_CHAR)
def characteristic_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams that one source over-uses."""
    b = _bigrams(spark, sf_dir)
    own = F.col("source") == "src0"
    c = b.groupBy("bigram").agg(F.count_if(own).alias("c_n"), F.count_if(~own).alias("c_d"))
    t = c.agg(F.sum("c_n").alias("n"), F.sum("c_d").alias("d"))
    s = c.where("c_n >= 4").crossJoin(F.broadcast(t))  # one row
    s = s.select("bigram", "c_n", "c_d", r6(stats.over_representation(F.col("c_n"), F.col("n"), F.col("c_d"), F.col("d"))).alias("score"))
    return s.orderBy(F.desc("score"), F.desc("c_n"), F.desc("bigram")).limit(15)


def _keep(spark: SparkSession):
    def keep(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep


_PICK = "row_number() OVER (PARTITION BY grp ORDER BY named DESC, score DESC, term DESC, id)"


@registry.add(
    f"""{_BI}, m AS (SELECT b.bigram, d.lang, b.doc_id FROM b JOIN documents d USING (doc_id) WHERE d.lang IS NOT NULL), s AS (SELECT lang, bigram, count(*)::DOUBLE AS score FROM m GROUP BY 1, 2 HAVING count(*) >= 3),
c AS (SELECT lang AS grp, 1 AS named, score, bigram AS term, doc_id AS id FROM m JOIN s USING (lang, bigram) UNION ALL SELECT lang, 0, NULL, NULL, doc_id FROM documents WHERE lang IS NOT NULL AND n_chars < 400),
p1 AS (SELECT grp, 1 AS place, term, id FROM c QUALIFY {_PICK} = 1),
p2 AS (SELECT grp, 2 AS place, term, id FROM c WHERE NOT EXISTS (FROM p1 p WHERE p.grp = c.grp AND (p.id = c.id OR p.term = c.term)) QUALIFY {_PICK} = 1),
p3 AS (SELECT grp, 3 AS place, term, id FROM c WHERE NOT EXISTS (FROM (FROM p1 UNION ALL FROM p2) p WHERE p.grp = c.grp AND (p.id = c.id OR p.term = c.term)) QUALIFY {_PICK} = 1)
FROM p1 UNION ALL FROM p2 UNION ALL FROM p3"""
)
def greedy_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language, one document for each of its best bigrams, none twice, three at most; short documents fill
    what is missing."""
    d = docs(spark, sf_dir).where("lang IS NOT NULL")
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    rows = d.select(F.col("lang").alias("grp"), F.col("doc_id").alias("id"), F.array_distinct(T.bigrams(tokens, STOP)).alias("terms"))
    scored = _keep(spark)(ranking.least_per_term(rows, 3).where("n >= 3"), "exemplar-terms")  # read several times
    found = scored.select("grp", F.col("n").cast("double").alias("score"), "term", F.explode("ids").alias("id"))
    return ranking.greedy_exemplars(found, 3, d.where("n_chars < 400").select(F.col("lang").alias("grp"), F.col("doc_id").alias("id")), _keep(spark))


_SWEEP = [("notice", r"Copyright|[Ll]icen[sc]e"), ("junk", r"!!|[#$%&*]{3}"), ("table", r" \| ")]
_ALSO = ("contact", r"@")


_CATEGORY = f"CASE {' '.join(f'WHEN {_hit(p)} THEN {chr(39)}{n}{chr(39)}' for n, p in _SWEEP)} ELSE 'plain' END || CASE WHEN {_hit('@')} THEN '+contact' ELSE '' END"
_SIZE_WINDOW = "CASE WHEN n_chars >= 1500 THEN 'trailing' WHEN n_chars >= 500 THEN 'preceding' END"


def size_window():
    """A stand-in for dates, which documents lack: long ones are of the trailing window."""
    return F.when(F.col("n_chars") >= 1500, "trailing").when(F.col("n_chars") >= 500, "preceding")


@registry.add(f"SELECT part AS category, count(*) AS n, count(*) FILTER (w = 'trailing') AS trailing, count(*) FILTER (w = 'preceding') AS preceding FROM (SELECT unnest(string_split({_CATEGORY}, '+')) AS part, {_SIZE_WINDOW} AS w FROM (SELECT coalesce(text, '') AS text, n_chars FROM documents)) GROUP BY 1")
def sweep_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matching category, and one that is added to it, by window."""
    cat = L.first_match(F.col("text"), _SWEEP, "plain", _ALSO)
    c = docs(spark, sf_dir).select(F.explode(F.split(cat, r"\+")).alias("category"), size_window().alias("w")).groupBy("category")
    return c.agg(F.count("*").alias("n"), *[F.count_if(F.col("w") == w).alias(w) for w in ("trailing", "preceding")])


@registry.add(f"{_L}, k AS (SELECT doc_id, {_CATEGORY} AS cat FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)) SELECT coalesce(labels[1], 'unclassified') AS label, count(*) AS n FROM l JOIN k USING (doc_id) WHERE cat <> 'plain' AND NOT starts_with(cat, 'table') GROUP BY 1 ORDER BY n DESC, label LIMIT 10")
def sweep_top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest labels of what the sweep found, one of its categories left out."""
    cat = L.first_match(F.col("text"), _SWEEP, "plain", _ALSO)
    d = docs(spark, sf_dir).select(F.explode(F.array(F.struct(cat.alias("cat"), LABELS.labels(F.col("text")).alias("labels")))).alias("x")).select("x.*")
    found = d.where((F.col("cat") != "plain") & ~F.col("cat").startswith("table"))
    return found.groupBy(F.coalesce(L.primary(F.col("labels")), F.lit("unclassified")).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(10)


@registry.add("SELECT doc_id, substr(text, greatest(pos - 50, 1), pos - greatest(pos - 50, 1) + len(m) + 50) AS context FROM (SELECT doc_id, text, regexp_extract(text, '[Ll]icen[sc]e') AS m, instr(text, regexp_extract(text, '[Ll]icen[sc]e')) AS pos FROM documents WHERE regexp_matches(text, '[Ll]icen[sc]e'))")
def weak_evidence_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first match with 50 characters of context."""
    return docs(spark, sf_dir).where(F.col("text").rlike(_EV)).select("doc_id", L.snippet(F.col("text"), _EV).alias("context"))


_PHRASES = ("rights reserved", "mit license", "apache license")


@registry.add("SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '(?:^|[^a-z0-9])rights\\s?reserved') THEN 'rights reserved' END, CASE WHEN regexp_matches(t, '(?:^|[^a-z0-9])mit\\s?license') THEN 'mit license' END, CASE WHEN regexp_matches(t, '(?:^|[^a-z0-9])apache\\s?license') THEN 'apache license' END], lambda x: x IS NOT NULL), ',') AS terms FROM (SELECT doc_id, regexp_replace(lower(strip_accents(coalesce(text, ''))), '-', ' ', 'g') AS t FROM documents) WHERE regexp_matches(t, '(?:^|[^a-z0-9])(rights\\s?reserved|mit\\s?license|apache\\s?license)')")
def phrase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in any case, accents and hyphens aside, with a boundary on the left only."""
    t = T.matching_form(F.col("text"))
    found = docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.array_compact(F.array(*[F.when(F.col("t").rlike(T.phrase_pattern(p, loose_left=True)), p) for p in _PHRASES])).alias("terms"))
    return found.where(F.size("terms") > 0).select("doc_id", F.array_join("terms", ",").alias("terms"))


_ITEM = "array_to_string(list_slice(string_split(regexp_replace(lower(strip_accents(trim(regexp_replace(regexp_replace(text, '[-_/]', ' ', 'g'), '\\s+', ' ', 'g')))), '[^a-z0-9 ]', '', 'g'), ' '), 1, 3), ' ')"
_FORM = "trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[-\u2010-\u2015_/\u2212]', ' ', 'g'), '\\s+', ' ', 'g'))"


@registry.add(
    f"""WITH p AS (SELECT DISTINCT trim({_ITEM}) AS phrase FROM benchmark), t AS (SELECT doc_id, {_FORM} AS t FROM documents)
SELECT phrase, count(*) AS docs, min(doc_id) AS first FROM p JOIN t ON phrase <> '' AND contains(replace(t, ' ', ''), replace(phrase, ' ', '')) AND regexp_matches(t, '(?:^|[^a-z0-9])' || replace(phrase, ' ', '\\s?')) GROUP BY 1"""
)
def phrase_table_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phrases of a table (the first three words of each item) at once, one pass over each text."""
    bare = F.regexp_replace(T.matching_form(F.col("text")), "[^a-z0-9 ]", "")
    items = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.split(bare, " "), 1, 3), " ").alias("phrase"))
    texts = docs(spark, sf_dir).select("doc_id", T.matching_form(F.col("text")).alias("t"))
    found = phrases.phrase_hits(texts, items, "t", "phrase")
    return found.groupBy("phrase").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))


_TITLED = "CASE label " + " ".join(f"WHEN '{r.key}' THEN {_hit(r.pattern, 'title')}" for r in LABELS.rules) + " ELSE false END"
_FITS = f"{_L}, t AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title FROM documents), f AS (SELECT x.*, {_TITLED} AS fits FROM x JOIN t USING (doc_id))"


def _fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, label, doc_id, and whether the label's pattern is in the title (the first line)."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    named = F.map_from_arrays(F.array(*[F.lit(r.key) for r in LABELS.rules]), F.array(*[title.rlike(r.pattern) for r in LABELS.rules]))
    rows = docs(spark, sf_dir).select("doc_id", "source", F.explode(F.array(F.struct(L.or_unclassified(LABELS.labels(F.col("text"))).alias("labels"), named.alias("named")))).alias("x"))
    return rows.select("doc_id", "source", "x.named", F.explode("x.labels").alias("label")).withColumn("fits", F.coalesce(F.try_element_at("named", F.col("label")), F.lit(False))).drop("named")


@registry.add(f"{_FITS} SELECT label, min(doc_id) FILTER (fits) AS first_id, count(*) AS n FROM f GROUP BY 1")
def title_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document, by id, of each label whose title names it; null if none does."""
    return _fits(spark, sf_dir).groupBy("label").agg(F.min(F.when(F.col("fits"), F.col("doc_id"))).alias("first_id"), F.count("*").alias("n"))


@registry.add(f"{_FITS}, c AS (SELECT source, label, count(*) AS n, min(doc_id) FILTER (fits) AS doc_id FROM f GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, label) AS rank FROM c) SELECT source, label, doc_id, rank = 1 AS is_leading FROM r WHERE rank <= 3 AND doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank) = 1")
def leading_exemplar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each source, the first titled document of its leading label, or else of the next two."""
    return ranking.first_of_leading(_fits(spark, sf_dir), "source", "label", "doc_id")


def store_labels(d: DataFrame, path: str) -> None:
    """The label table as Parquet, each list beside the whole text that it came from."""
    d.select("doc_id", "text", LABELS.labels(F.col("text")).alias("labels")).write.parquet(path)


def differing(stored: DataFrame) -> DataFrame:
    """Rows of a stored label table, and those whose list isn't the one that every rule gives now; null lists differ."""
    again = stored.select("labels", F.explode(F.array(LABELS.labels(F.col("text")))).alias("again"))
    return again.agg(F.count("*").alias("n"), F.count_if(~F.col("labels").eqNullSafe(F.col("again"))).alias("differs"))


def _chained_sql() -> str:
    """The label list again, by joined strings of cases."""
    case = lambda r: f"CASE WHEN len(regexp_extract_all(text, '{q(r.pattern)}')) > 0{f' AND len(regexp_extract_all(text, {chr(39)}{q(r.exclude)}{chr(39)})) = 0' if r.exclude else ''} THEN '{r.key},' ELSE '' END"
    regular, rest = (" || ".join(map(case, [r for r in LABELS.rules if r.residual == side])) for side in (False, True))
    return f"CASE WHEN {regular} <> '' THEN {regular} ELSE CASE WHEN {rest} <> '' THEN split_part({rest}, ',', 1) || ',' ELSE '' END END"


@registry.add(f"{_L}, a AS (SELECT doc_id, {_chained_sql()} AS again FROM l0) SELECT count(*) AS n, count(*) FILTER (array_to_string(labels, ',') || CASE WHEN len(labels) > 0 THEN ',' ELSE '' END IS DISTINCT FROM again) AS differs FROM l JOIN a USING (doc_id)")
def retag_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose stored label list and the one recomputed from the whole text differ (none)."""
    path = scratch(spark, "labels")
    store_labels(docs(spark, sf_dir), path)
    return differing(spark.read.parquet(path))


@registry.add("SELECT term, count(DISTINCT doc_id) AS docs, sum(n)::BIGINT AS hits FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(moron|stupid|trash|disgusting|License|Copyright)')) AS term FROM documents) GROUP BY ALL) GROUP BY 1")
def matched_term_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms matched, by documents and in all."""
    t = docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("(moron|stupid|trash|disgusting|License|Copyright)"), F.lit(1))).alias("term"))
    return t.groupBy("term").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("hits"))
