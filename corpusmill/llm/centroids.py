"""Exact k-means in whole numbers by annulus search.

Components are ``floor(scale * x)``, centroids floors of exact means, distances squared and exact, so results depend neither
on the order of rows nor on how they are divided.

A round is one pass over the vectors, which carry the centroid of the round before.  The distance to that centroid, where it
is now, bounds the distance to the nearest one; a centroid within that distance has a norm within it of the vector's norm
(triangle inequality).  Centroids are sorted by norm, the annulus of each vector is found by binary search, widened by more
than rounding can err so that ties on its boundary are in, and only the centroids in it are compared, exactly; ties go to
the smaller number.  The first round starts from the centroid nearest in norm.  A task writes its vectors with their new
centroid, and one row a centroid with the sums of its vectors: sums are added before they are shuffled, and the driver gets
``k`` rows a round.  The table of the round before is deleted when the next is written, so two stand at a time.

Vectors of another width than ``width``, null ones, and those with null, NaN or infinite components take no part.  The first
centroids are the vectors of least hash; repeated ids tie by components, a null id counts as empty text, and fewer vectors
than ``k`` give as many centroids.  A repeated row counts once for each row, a centroid without vectors stays.  Components
over 2**27 in size raise, as squared distances of a ``long`` could not hold them.  An empty table gives no rows.  Columns
other than the two named are not read, so names never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import lean
from .shared import drop, new_path, ship

CLUSTERS, ROUNDS, WIDTH, SCALE, SEED = 40, 5, 64, 256, "2:"
LARGEST, FLOAT_EXACT, CHUNK = 1 << 27, 1 << 23, 4096
STATE = "id long, v array<int>, cluster int, distance long, n long, sums array<long>, inertia decimal(38,0)"


class Annulus:
    """Centroids by norm."""

    def __init__(self, centers: np.ndarray):
        self.centers = centers
        self.squares = (centers * centers).sum(axis=1)
        self.by_norm = np.argsort(self.squares, kind="stable")
        self.norms = np.sqrt(self.squares[self.by_norm].astype(np.float64))
        self.exact = np.float64 if np.abs(centers).max() <= FLOAT_EXACT else np.int64

    def distances(self, v: np.ndarray, squares: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distance of each vector to its own of ``which``."""
        kind = self.exact if not len(v) or np.abs(v).max() <= FLOAT_EXACT else np.int64  # products of floats are exact below 2**53
        inner = np.einsum("ij,ij->i", v.astype(kind), self.centers[which].astype(kind))
        return squares + self.squares[which] - 2 * inner.astype(np.int64)

    def nearest(self, v: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each vector, the squared distance to it, and how many comparisons that took."""
        squares = (v * v).sum(axis=1)
        norm = np.sqrt(squares.astype(np.float64))
        if before is None:
            right = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(self.norms) - 1))
            closer = (right == len(self.norms)) | (norm - self.norms[right - 1] <= self.norms[np.minimum(right, len(self.norms) - 1)] - norm)
            before = self.by_norm[np.where(closer, right - 1, np.minimum(right, len(self.norms) - 1))]
        best, least = before.astype(np.int64), self.distances(v, squares, before)
        bound = np.sqrt(least.astype(np.float64))
        bound += 1e-9 * (bound + norm + self.norms[-1]) + 1e-6
        low, high = np.searchsorted(self.norms, norm - bound, "left"), np.searchsorted(self.norms, norm + bound, "right")
        done = len(v)
        for place, j in enumerate(self.by_norm.tolist()):
            rows = np.flatnonzero((low <= place) & (place < high) & (before != j))
            done += len(rows)
            d = self.distances(v[rows], squares[rows], np.full(len(rows), j))
            better = (d < least[rows]) | (d == least[rows]) & (j < best[rows])
            best[rows[better]], least[rows[better]] = j, d[better]
        return best, least, done


def _assigned(centers: list[list[int]], width: int, known: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring, k = Annulus(np.array(centers, dtype=np.int64)), len(centers)
        n, sums, inertia = np.zeros(k, np.int64), np.zeros((k, width), np.int64), [0] * k
        names = ["id", "v", "cluster", "distance", "n", "sums", "inertia"]
        for batch in batches:
            for a in range(0, len(batch), CHUNK):
                part = batch.slice(a, CHUNK)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
                best, least, _ = ring.nearest(v, part.column("cluster").to_numpy(zero_copy_only=False) if known else None)
                n += np.bincount(best, minlength=k)
                order = np.argsort(best, kind="stable")
                met, first = np.unique(best[order], return_index=True)
                if len(met):
                    sums[met] += np.add.reduceat(v[order], first, axis=0)
                for j, mine in zip(met.tolist(), np.split(least[order], first[1:])):
                    inertia[j] += sum(mine.tolist())  # of any size
                nulls = [pa.nulls(len(part), t) for t in (pa.int64(), pa.list_(pa.int64()), pa.decimal128(38, 0))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(best.astype(np.int32)), pa.array(least), *nulls], names)
        mine = np.flatnonzero(n).tolist()
        none = [pa.nulls(len(mine), t) for t in (pa.int64(), pa.list_(pa.int32()))]
        totals = [pa.array(n[mine]), pa.array(sums[mine].tolist(), pa.list_(pa.int64())), pa.array([Decimal(inertia[j]) for j in mine], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays([*none, pa.array(mine, pa.int32()), pa.nulls(len(mine), pa.int64()), *totals], names)

    return lean(run)


@dataclass
class Clustering:
    """rows: id, v, cluster, distance; ``centers``, and the summed distance of each."""

    rows: DataFrame
    centers: list[list[int]]
    inertia: list[int]


def whole_vectors(vectors: DataFrame, width: int, scale: int, key: str, vector: str) -> DataFrame:
    """id, v: the scaled components of the vectors that take part."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    x = F.col(vector).cast("array<double>")
    too_large = F.raise_error(F.lit(f"a component is over {LARGEST} in size after scaling")).cast("int")
    whole = lambda y: F.when(F.abs(y) <= LARGEST, y.cast("int")).otherwise(too_large)
    return vectors.where(F.col(vector).isNotNull() & (F.size(vector) == width) & F.forall(x, real)).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda y: whole(F.floor(F.lit(float(scale)) * y))).alias("v"))


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: str = SEED, key: str = "vec_id", vector: str = "embedding") -> Clustering:
    spark = ship(vectors.sparkSession)

    def write(df: DataFrame, name: str, old: str | None) -> tuple[DataFrame, str]:
        path = new_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        if old:
            drop(spark, old)
        return spark.read.schema(df.schema).parquet(path), path

    state, path = write(whole_vectors(vectors, width, scale, key, vector), "centroid-vectors", None)
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    centers = [list(r.v) for r in state.orderBy(hashed, "v").limit(k).collect()]
    inertia = [0] * len(centers)
    state = state.withColumn("cluster", F.lit(None).cast("int"))
    if not centers:
        return Clustering(state.withColumn("distance", F.lit(None).cast("long")), [], [])
    for done in range(rounds + 1):
        state, path = write(state.select("id", "v", "cluster").mapInArrow(_assigned(centers, width, done > 0), STATE), "centroid-round", path)
        sums, state = state.where("n IS NOT NULL"), state.where("n IS NULL")
        if done == rounds:
            found = sums.groupBy("cluster").agg(F.sum("inertia").alias("s")).collect()  # a row a centroid
            for r in found:
                inertia[r.cluster] = int(r.s)
            break
        exact = sums.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
        for r in exact.collect():  # k * width rows
            centers[r.cluster][r.i] = int(r.s) // r.n
    return Clustering(state.select("id", "v", "cluster", "distance"), centers, inertia)


def cluster_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    found = cluster(vectors)
    digest = [(j, found.inertia[j], hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centers)]
    each = vectors.sparkSession.createDataFrame(digest, "cluster int, cluster_inertia long, centroid_sha256 string")
    rows = found.rows.join(F.broadcast(each), "cluster")  # k rows
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", F.lit(sum(found.inertia)).cast("long").alias("inertia"), "centroid_sha256")


def digest_sql(k: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> str:
    """DuckDB SQL of the digest: every vector against every centroid."""
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS c, e FROM (SELECT * FROM v ORDER BY sha256('2:' || vec_id), e LIMIT {k}))",
    ]
    for i in range(1, rounds + 2):
        ctes.append(
            f"a{i} AS MATERIALIZED (SELECT r, min({{'d': list_sum(list_transform(range(1, {width + 1}), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::BIGINT, 'c': c.c}}) AS m FROM v, c{i - 1} c GROUP BY r)"
        )
        if i <= rounds:
            ctes.append(
                f"""s{i} AS MATERIALIZED (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e
    FROM (SELECT a.m.c AS c, i, sum(v.e[i])::BIGINT AS s, count(*) AS n FROM a{i} a JOIN v USING (r), range(1, {width + 1}) t(i) GROUP BY ALL) GROUP BY c),
c{i} AS MATERIALIZED (SELECT c.c, coalesce(s.e, c.e) AS e FROM c{i - 1} c LEFT JOIN s{i} s USING (c))"""
            )
    last = f"a{rounds + 1}"
    return (
        "WITH "
        + ",\n".join(ctes)
        + f"""
SELECT v.vec_id, a.m.c::INT AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia,
    (sum(a.m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM {last} a JOIN v USING (r) JOIN c{rounds} c ON c.c = a.m.c
"""
    )


DIGEST_SQL = digest_sql()
