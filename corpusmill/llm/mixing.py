"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: sources in code point order (null last) weigh ``weights`` in turn and share ``share`` times all words;
no target passes ``cap`` times its source's words, the excess goes to the others by weight.

Each document of a source is taken ``floor(target / source words)`` times for certain.  What is left of the target is
drawn as one copy more, with inclusion probabilities in proportion to size: ``min(1, alpha * size)``, where ``alpha``
makes the expected words meet the rest.  Documents of probability 1 are whole copies for certain too; the others are
ranked by random odds over inclusion odds, and those of least rank are taken until their words come nearest to what is
left.  Probabilities differ from document to document, so the order of ranks is not that of the random numbers.

No source is ever sorted as a whole: ``alpha`` comes from exact sums by distinct size, words are summed by rank bucket
first, and only the one bucket that the target falls into is ranked; there are more buckets the more documents there
are.  Every row is decided alone: its random number comes from its doc_id and its text, so rows under one doc_id, or
without one, have their own; rows that repeat both are one group in the ranking, and where the target falls into such a
group, as many of its rows are taken as come nearest to it, the first ones in a table that is written once.

Nulls: a null text has size 0, a null source is a source, a null doc_id ranks like any other.  Texts of any length count
whole.  Ties in rank go by doc_id (null first), then by text hash.  Documents without words are taken for certain or not
at all.  Empty tables give empty results.  Columns named as this module's
own keep their values: its own get underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh, staged

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 4096
BROADCAST_SOURCES = 50_000
SEED = "mix1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    return F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 16)


def uniform_of(doc_id: Column, key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from the id and the text's key, the same on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4503599627370496.0)


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """A row for each source: source, source_size, target.  The windows see one row a source, never documents."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(whole) - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    per = per.withColumn("level", left / F.sum("weight").over(after))
    level = F.max("level").over(whole)
    return per.select("source", "source_size", F.least(F.lit(float(cap)) * F.col("source_size"), F.col("weight") * level).alias("target"))


def inclusion(alpha: Column, size: Column) -> Column:
    """The probability of one copy more."""
    return F.least(F.lit(1.0), alpha * size)


def pareto_rank(u: Column, share: Column) -> Column:
    """Random odds over inclusion odds; null where the odds are zero."""
    return F.when(share > 0, u * (1 - share) / ((1 - u) * share))


def _bucket(rank: Column, buckets: int | Column) -> Column:
    """Rises with the rank."""
    return F.floor(rank / (1 + rank) * buckets)


def inclusion_rates(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """A row for each source: ``alpha`` and ``certain``, the size above which a document is taken for certain.

    If sizes above s are certain, alpha(s) = (rest - their words) / sum of squares of the others; the s asked for is the
    greatest with alpha(s) * s <= 1.  The windows see one row a distinct size; the sums are exact decimals."""
    by = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    words = F.col("size").cast("decimal(20,0)") * F.col("n")
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by = by.withColumn("low", F.sum(words).over(up)).withColumn("square", F.sum((words * F.col("size")).cast("decimal(38,0)")).over(up)).alias("b")
    by = by.join(_small(plan.select(F.col("source").alias("plan_source"), "source_size", "rest")), F.col("source").eqNullSafe(F.col("plan_source")))
    above = F.col("source_size") - F.col("low").cast("double")
    by = by.withColumn("alpha", (F.col("rest") - above) / F.col("square").cast("double"))
    by = by.where(F.col("alpha") * F.col("size") <= 1)
    return by.groupBy("source").agg(F.max_by("alpha", "size").alias("alpha"), F.max("size").alias("certain"), F.max_by(above, "size").alias("above"))


def cutoffs(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """A row for each source: its target, certain copies, inclusion rate, and the rank up to which one copy more is taken."""
    plan = source_targets(sizes, share, cap, weights)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = staged(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    rates = staged(inclusion_rates(sizes, plan), "mix-rates")
    count = sizes.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    buckets = 1 << max(6, (count // BUCKET_ROWS).bit_length())
    r = _small(rates.select(F.col("source").alias("rate_source"), "alpha", "certain"))
    drawn = sizes.join(r, F.col("source").eqNullSafe(F.col("rate_source"))).where(F.col("size") <= F.col("certain"))
    drawn = drawn.withColumn("rank", pareto_rank(F.col("u"), inclusion(F.col("alpha"), F.col("size")))).where("rank IS NOT NULL")
    drawn = drawn.withColumn("bucket", _bucket(F.col("rank"), buckets))
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    binned = drawn.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    binned = binned.withColumn("before", F.sum("words").over(up) - F.col("words")).alias("b")
    left = plan.alias("p").join(rates.alias("r"), F.col("p.source").eqNullSafe(F.col("r.source")))
    left = left.select(F.col("p.source").alias("left_source"), (F.col("rest") - F.col("above")).alias("left"))
    edge = binned.join(_small(left), F.col("source").eqNullSafe(F.col("left_source")))
    # Where all is taken the last bucket is the edge.
    last_bucket = F.max("bucket").over(Window.partitionBy("source"))
    edge = edge.withColumn("last", last_bucket).where((F.col("before") < F.col("left")) & ((F.col("before") + F.col("words") >= F.col("left")) | (F.col("bucket") == F.col("last"))))
    edge = staged(edge.select(F.col("source").alias("edge_source"), "left", F.col("bucket").alias("edge_bucket"), "before"), "mix-edge")
    within = drawn.join(_small(edge), F.col("source").eqNullSafe(F.col("edge_source")) & (F.col("bucket") == F.col("edge_bucket")))
    # Rows that repeat id and text are one row here, however many they are.
    within = within.groupBy("source", "left", "before", _place(F.col("rank")).alias("last"), "size").agg(F.count("*").alias("peers"))
    run = Window.partitionBy("source").orderBy("last").rowsBetween(Window.unboundedPreceding, -1)
    within = within.withColumn("upto", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("peers")).over(run), F.lit(0)))
    # The j-th of equal rows is taken if its middle is not past what is left.
    fit = F.floor((F.col("left") - F.col("upto")) / F.col("size") + 0.5)
    last = within.withColumn("some", F.least(F.col("peers"), fit)).where("some >= 1").groupBy(F.col("source").alias("last_source")).agg(F.max("last").alias("last"), F.max_by("some", "last").alias("some"))
    cut = plan.drop("rest").join(rates.select(F.col("source").alias("rate_source"), "alpha", "certain"), F.col("source").eqNullSafe(F.col("rate_source")), "left")
    cut = cut.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left").join(last, F.col("source").eqNullSafe(F.col("last_source")), "left")
    return staged(cut.select(F.col("source").alias("cut_source"), "source_size", "target", "whole", "alpha", "certain", F.lit(buckets).alias("buckets"), "edge_bucket", "last", "some"), "mix-cut")


def _place(rank: Column, doc_id: Column | None = None, key: Column | None = None) -> Column:
    """What orders documents within a source: rank, then doc_id (null first), then text."""
    doc_id = F.col("doc_id") if doc_id is None else doc_id
    return F.struct(rank.alias("rank"), doc_id.isNotNull().alias("known"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), (F.col("key") if key is None else key).alias("key"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table of one row a source when its count is known to be small; else Spark joins as it sees fit."""
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


MIXED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def _sizes(docs: DataFrame, seed: str) -> DataFrame:
    sizes = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), text_key(F.col("text")).alias("key"))
    return staged(sizes.withColumn("u", uniform_of(F.col("doc_id"), F.col("key"), seed)), "mix-sizes")


def pareto_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source and any others) and, as its last four columns, MIXED: the document's words, its
    source's, its source's target, and how often it is taken.  A name that ``docs`` has already gets underscores."""
    cut = cutoffs(_sizes(docs, seed), share, cap, weights)
    return _apply(docs, size_of(F.col("text")), text_key(F.col("text")), cut, seed)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of a mix as often as it is taken, with ``columns`` alone."""
    copies = mixed.columns[-1]
    times = fresh("mix_time", mixed.columns)
    taken = mixed.where(F.col(copies) > 0)
    return taken.withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*columns)


def _first_rows(edge: DataFrame, source: str, place: str, some: str) -> DataFrame:
    """edge_source and upto: the place of the row of each source up to which there are ``some``.  Rows are counted by task
    that wrote them; only those of the one task where the count is reached are numbered."""
    rows = edge.select(F.col(source).alias("edge_source"), F.col(some).alias("some"), F.col(place).alias("place"), F.shiftright(place, 33).alias("task"))
    count = rows.groupBy("edge_source", "task").agg(F.count("*").alias("n"), F.first("some").alias("some"))
    count = count.withColumn("before", F.sum("n").over(Window.partitionBy("edge_source").orderBy("task")) - F.col("n"))
    count = count.where((F.col("before") < F.col("some")) & (F.col("before") + F.col("n") >= F.col("some")))
    count = _small(staged(count.select(F.col("edge_source").alias("at_source"), F.col("task").alias("at_task"), "before"), "mix-reached"))
    rows = rows.join(count, F.col("edge_source").eqNullSafe(F.col("at_source")) & (F.col("task") == F.col("at_task")))
    number = F.row_number().over(Window.partitionBy("edge_source").orderBy("place")) + F.col("before")
    return rows.withColumn("number", number).where("number = some").select("edge_source", F.col("place").alias("upto"))


def _apply(docs: DataFrame, size: Column, key: Column, cut: DataFrame, seed: str) -> DataFrame:
    names = list(docs.columns)
    own = {c: fresh(f"mix_cut_{c}", names) for c in cut.columns}
    cut = _small(cut.select(*[F.col(c).alias(n) for c, n in own.items()]))
    of = {c: F.col(n) for c, n in own.items()}
    joined = docs.join(cut, F.col("source").eqNullSafe(of["cut_source"]))
    at_last = F.col("doc_id").isNotNull().eqNullSafe(of["last"]["known"]) & (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) == of["last"]["id"])
    # One item exploded, so that the words are counted once a text and not in each place that uses the number.
    held = fresh("mix_held", names)
    keyed = joined.withColumn(held, F.explode(F.array(F.struct(size.alias("size"), key.alias("key"), uniform_of(F.col("doc_id"), key, seed).alias("u")))))
    size, key, u = (F.col(held)[c] for c in ("size", "key", "u"))
    rank = pareto_rank(u, inclusion(of["alpha"], size))
    bucket = _bucket(rank, of["buckets"])
    drawn = (bucket < of["edge_bucket"]) | ((bucket == of["edge_bucket"]) & (_place(rank, key=key) < of["last"]))
    certain = F.coalesce(size > of["certain"], F.lit(False))
    tied = F.coalesce(~certain & (_place(rank, key=key) == of["last"]), F.lit(False))

    def out(rows: DataFrame, extra: Column) -> DataFrame:
        values = (size, of["source_size"], of["target"], (of["whole"] + extra.cast("long")).cast("long"))
        return rows.select(*names, *[v.alias(fresh(n, names)) for n, v in zip(MIXED, values)])

    # The rows of the group that the target falls into, mostly one a source.
    place = fresh("mix_place", [*names, *own.values(), held])
    edge = staged(keyed.where(at_last).where(tied).withColumn(place, F.monotonically_increasing_id()), "mix-tied")
    first = _small(_first_rows(edge, "source", place, own["some"]))
    upto = fresh("mix_upto", [*names, *own.values(), held, place])
    first = first.select(F.col("edge_source").alias(fresh("mix_edge_source", names)), F.col("upto").alias(upto))
    edge = edge.join(first, F.col("source").eqNullSafe(F.col(first.columns[0])), "left")
    return out(keyed.where(~tied), certain | F.coalesce(drawn, F.lit(False))).unionByName(out(edge, F.coalesce(F.col(place) <= F.col(upto), F.lit(False))))


def mix_digest(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken.  The texts are read once."""
    sizes = _sizes(docs, seed)
    out = _apply(sizes.drop("u"), F.col("size"), F.col("key"), cutoffs(sizes, share, cap, weights), seed)
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


DIGEST_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    substr(md5(coalesce(text, '')), 1, 16) AS key,
    (('0x' || substr(md5('mix1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || key), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM p),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * max(level) OVER ()) AS target FROM l),
v AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
e AS (SELECT *, target - whole * source_size AS rest FROM v),
z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size),
y AS (SELECT *, sum(size::HUGEINT * n) OVER up AS low, sum(size::HUGEINT * size * n) OVER up AS square FROM z WINDOW up AS (PARTITION BY source ORDER BY size)),
x AS (SELECT y.source, y.size, source_size - low::DOUBLE AS above, (rest - (source_size - low::DOUBLE)) / square::DOUBLE AS alpha FROM y JOIN e ON y.source IS NOT DISTINCT FROM e.source),
i AS (SELECT source, arg_max(alpha, size) AS alpha, max(size) AS certain, arg_max(above, size) AS above FROM x WHERE alpha * size <= 1 GROUP BY source),
j AS (SELECT d.doc_id, d.size, d.key, d.u, e.*, i.certain, e.rest - i.above AS remaining, least(1.0::DOUBLE, i.alpha * d.size) AS share
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN i ON d.source IS NOT DISTINCT FROM i.source),
k AS (SELECT *, size <= certain AND share > 0 AS ranked, CASE WHEN size <= certain AND share > 0 THEN u * (1 - share) / ((1 - u) * share) END AS pareto FROM j),
c AS (SELECT *, sum(size) OVER (PARTITION BY source, ranked ORDER BY pareto, doc_id NULLS FIRST, key ROWS UNBOUNDED PRECEDING) AS upto FROM k)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN size > certain OR ranked AND 2 * upto - size <= 2 * remaining THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
