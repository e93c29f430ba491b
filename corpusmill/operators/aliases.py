"""Works under several keys: merging ordered lanes, closing alias chains, and foreign keys after the merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..deploy import kept


def require_none(rows: DataFrame, message: str) -> None:
    """Raise with a few of ``rows`` if there are any."""
    found = rows.limit(5).collect()
    if found:
        raise ValueError(f"{message}: {', '.join(str(r.asDict()) for r in found)}")


def close_aliases(aliases: DataFrame) -> DataFrame:
    """alias, key, steps: every alias with the end of its chain, and how many links the chain has.

    Pointer jumping: each round an alias takes the key of the key it points to, so chains halve and rounds grow with the
    logarithm of the longest.  An alias with two keys raises, and so does a circle, which would never end.  Links with a
    null end say nothing and are left out; repeated links count once."""
    links = aliases.select("alias", "key").where("alias IS NOT NULL AND key IS NOT NULL").distinct()
    rows = kept(links.withColumn("steps", F.lit(1).cast("long")), "aliases")
    require_none(rows.groupBy("alias").agg(F.count("*").alias("keys")).where("keys > 1"), "an alias stands for two keys")
    done, rounds = None, 0
    limit = rows.count().bit_length() + 1
    while True:
        hop = rows.select(F.col("alias").alias("at"), F.col("key").alias("next"), F.col("steps").alias("more"))
        moved = rows.join(hop, F.col("key") == F.col("at"), "left")
        moved = kept(moved.select("alias", F.coalesce("next", "key").alias("key"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("open")), "aliases")
        require_none(moved.where("alias = key").select("alias"), "aliases go round in a circle")
        done = moved.select("alias", "key", "steps")
        if moved.where("open").isEmpty():
            return done
        rows, rounds = done, rounds + 1
        if rounds > limit:
            require_none(moved.where("open").select("alias"), "aliases go round in a circle")


def merge_lanes(refs: DataFrame, identity: str, key: str, order: list[str], superseded: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The works (the first row of each identity, by ``order`` and key) and alias, key, steps of all other keys.

    ``superseded`` (alias, key) names keys that give way to others before identities are looked at; chains through both
    kinds are followed to their end.  Raises where a merge would lose a work: one key names two works, one key stands for
    two works in different lanes, or a key is both a work's own and an alias.  A null identity is a work of its own under
    its key; rows without a key are left out."""
    rows = refs.where(F.col(key).isNotNull())
    gone = None
    if superseded is not None:
        gone = superseded.join(rows.select(F.col(key).alias("alias")).distinct(), "alias", "left_semi").select("alias", "key")
        rows = rows.join(gone.select(F.col("alias").alias(key)), key, "left_anti")
    own = F.struct(F.col(identity).isNull().alias("none"), F.coalesce(F.col(identity).cast("string"), F.col(key).cast("string")).alias("id"))
    rows = rows.withColumn("merge_id", own)
    works = kept(rows.groupBy("merge_id").agg(F.min_by(F.struct(*refs.columns), F.struct(*order, key)).alias("row")), "works")
    require_none(works.groupBy(F.col(f"row.{key}").alias("key")).agg(F.count("*").alias("works")).where("works > 1"), "a key names two works")
    links = rows.select(F.col(key).alias("alias"), "merge_id").distinct().join(works.select("merge_id", F.col(f"row.{key}").alias("key")), "merge_id").where("alias <> key").select("alias", "key")
    known = works.select(F.col(f"row.{key}").alias("alias"))
    require_none(links.join(known, "alias", "left_semi").select("alias"), "a key is both a work's own and an alias")
    closed = close_aliases(links if gone is None else links.unionByName(gone))
    return works.select("row.*"), closed


def rewrite_keys(rows: DataFrame, foreign: str, aliases: DataFrame, works: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``foreign`` replaced by the key that it stands for.  A key that then names no work raises; null foreign
    keys stay null."""
    to = aliases.select(F.col("alias").alias("merge_alias"), F.col("key").alias("merge_key"))
    target: Column = F.coalesce("merge_key", foreign)
    out = rows.join(to, F.col(foreign) == F.col("merge_alias"), "left")
    out = out.select(*[(target if c == foreign else F.col(c)).alias(c) for c in rows.columns])
    # Keys are combined before they meet the works, however many rows have them.
    asked = out.groupBy(foreign).agg(F.count("*").alias("rows")).where(F.col(foreign).isNotNull())
    require_none(asked.join(works.select(F.col(key).alias(foreign)), foreign, "left_anti"), f"{foreign} names no work")
    return out
