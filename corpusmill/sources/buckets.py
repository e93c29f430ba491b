"""Tables in buckets of a key, written once and joined without another shuffle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

BUCKETS = 16


def bucketed(rows: DataFrame, key: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` as a table in ``path``, in ``buckets`` buckets by the hash of ``key``, each sorted by it.  Rows are dealt to the
    buckets before they are written, so there is one file a bucket; null keys share one."""
    name = f"bucketed_{uuid.uuid4().hex}"
    rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    return rows.sparkSession.table(name)


def join_buckets(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A merge join of two tables in equal buckets of ``key``: a task reads the same bucket of both, and no exchange is
    planned.  Columns of both sides keep their names; take them by ``left[...]`` and ``right[...]``."""
    return left.hint("merge").join(right.hint("merge"), left[key] == right[key], how)
