"""Keep-first, version collapse and identity merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, key: list[str | Column], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``: an aggregation of whole rows, combined before the shuffle, no sort."""
    cols = rows.columns
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("row"))
    return best.select("row.*")


def keep_last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
    return best.select("row.*")


def number_versions(rows: DataFrame, base: str, version: str) -> DataFrame:
    """A row without a version number is version 1 if its work has other rows."""
    w = Window.partitionBy(base)
    return rows.withColumn(version, F.when(F.col(version).isNull() & (F.count("*").over(w) > 1), F.lit(1)).otherwise(F.col(version)))


def first_version_ids(rows: DataFrame, base: str, version: str, separator: str) -> DataFrame:
    """base, place, id: where version 1 of a work that lacks it may be found: under the work's separator and 'v1', and
    with '-' under its bare id too (older works have no suffix)."""
    works = rows.groupBy(base).agg(F.max(separator).alias("sep"), F.count(version).alias("numbered"), F.count_if(F.col(version) == 1).alias("ones"))
    works = works.where((F.col("numbered") > 0) & (F.col("ones") == 0))
    ids = F.array_compact(F.array(F.concat(F.col(base), F.col("sep"), F.lit("v1")), F.when(F.col("sep") == "-", F.col(base))))
    return works.select(base, F.posexplode(ids).alias("place", "id"))


def fetched_first_versions(rows: DataFrame, works: DataFrame, base: str, version: str, separator: str, id_: str) -> DataFrame:
    """Version 1 of each work that lacks it, from a table of single works: the first candidate that exists."""
    wanted = first_version_ids(rows, base, version, separator).join(works.withColumnRenamed(id_, "id"), "id")
    first = wanted.groupBy(base).agg(F.min_by(F.struct(*[c for c in wanted.columns if c != base]), "place").alias("w"))
    return first.select(base, "w.*").drop("place")


def collapse_versions(rows: DataFrame, base: str, version: str, date: str, texts: tuple[str, ...], lists: tuple[str, ...] = ()) -> DataFrame:
    """One row a work: version 1 if there is one (a row without a number among others counts as that), else the
    earliest; its date is the earliest of all; an empty text comes from the highest version; the lists of all versions
    in order of date and version, each item once; and the versions themselves, ascending."""
    rows = number_versions(rows, base, version)
    first = F.struct((~F.coalesce(F.col(version) == 1, F.lit(False))).alias("other"), F.coalesce(F.nullif(F.col(date), F.lit("")), F.lit("9999")).alias("date"), F.coalesce(version, F.lit(0)).alias("v"), *texts)
    place = F.struct(F.coalesce(F.nullif(F.col(date), F.lit("")), F.lit("9999")).alias("d"), F.coalesce(version, F.lit(0)).alias("v"))
    out = rows.groupBy(base).agg(
        F.min_by(F.struct(version, *texts), first).alias("chosen"),
        F.max_by(F.struct(*texts), F.struct(F.coalesce(version, F.lit(0)), *texts)).alias("latest"),
        F.min(F.nullif(F.col(date), F.lit(""))).alias(date),
        F.count("*").alias("n_versions"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(version, F.lit(0)).alias("v"), date))), lambda x: x["v"]).alias("versions"),
        *[F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col(c).alias("x")))), lambda x: x["x"]))).alias(c) for c in lists],
    )
    whole = [F.coalesce(F.nullif(F.col(f"chosen.{t}"), F.lit("")), F.col(f"latest.{t}")).alias(t) for t in texts]
    return out.select(base, F.col(f"chosen.{version}").alias(version), *whole, date, "n_versions", "versions", *lists)


def highest_record(rows: DataFrame, concept: str, record: str, terms: str) -> DataFrame:
    """The row of the highest record id of each concept, with the terms of all its rows, each once, in id order."""
    best = rows.groupBy(concept).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (concept, terms)]), F.col(record)).alias("row"), F.transform(F.array_sort(F.collect_list(F.struct(record, terms))), lambda x: x[terms]).alias("all"))
    return best.select(concept, "row.*", F.array_distinct(F.flatten("all")).alias(terms))


def merge_identities(rows: DataFrame, identity: str, key: str, lane: str) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, aliases): the first lane names a thing; other keys of it become aliases."""
    named = rows.groupBy(identity).agg(F.min_by(key, F.struct(lane, key)).alias("canonical"), F.count("*").alias("n"))
    aliases = rows.join(named, identity).where(F.col(key) != F.col("canonical")).select(F.col(key).alias("alias"), "canonical").distinct()
    return named, aliases


def apply_edits(rows: DataFrame, edits: DataFrame, key: str, field: str) -> DataFrame:
    """Edits (key, old, new) take effect where the field holds ``old`` and the edit meets exactly one row."""
    met = rows.join(edits, key).where(F.col(field) == F.col("old")).groupBy(key, "old", "new").agg(F.count("*").alias("hits")).where("hits = 1")
    single = met.groupBy(key).agg(F.min_by("old", F.struct("old", "new")).alias("old"), F.min_by("new", F.struct("old", "new")).alias("new"))
    out = rows.join(single, key, "left")
    edited = F.coalesce(F.col(field) == F.col("old"), F.lit(False))
    return out.withColumn("edited", edited).withColumn(field, F.when(edited, F.col("new")).otherwise(F.col(field))).drop("old", "new")
