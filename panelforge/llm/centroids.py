"""Centroid clustering with block-norm screening, in exact integers.

A vector's entries are cut into segments, and the norms of its segments are its compressed form,
computed once and kept beside it. By Cauchy and Schwarz the dot product of two vectors is at most
that of their compressed forms, so the squared distance is at least |v|^2 + |c|^2 less twice that:
a product of small matrices gives such bounds for all centroids. The centroid of the least bound is
measured first; of the others, only those whose bound isn't above the best distance so far get
an exact integer distance. Rounds hand on sums by centroid, which are as many as k times the
dimension, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import LONG, digits, floors, from_digits, largest, vectors
from .tables import Rounds

SEGMENT = 4
#: Squared distances of vectors whose entries are all below this are exact in longs, if they have at most 4,096.
SHORT = 1 << 24
#: Bounds that a task holds at once.
CELLS = 1 << 22


def segment_norms(x: np.ndarray, segment: int) -> np.ndarray:
    """The compressed form of each row: the norms of its segments, the last of which may be shorter."""
    squares = np.asarray(x, dtype=float) ** 2
    return np.sqrt(np.add.reduceat(squares, np.arange(0, x.shape[1], segment), axis=1))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the number of the nearest centroid (of equals the smaller), the exact squared distance, and how many distances it took."""
    most = max(1, CELLS // len(centroids))
    if len(x) > most:
        parts = [nearest(x[a : a + most], norms[a : a + most], centroids, segment) for a in range(0, len(x), most)]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    short = max(largest(x), largest(centroids)) < SHORT and x.shape[1] <= 4_096
    x, c = (x.astype(np.int64), centroids.astype(np.int64)) if short else (x.astype(object), centroids.astype(object))
    their = segment_norms(centroids, segment)
    sizes = (norms**2).sum(1)[:, None] + (their**2).sum(1)[None]
    # 1e-9 of the terms is far more than what rounding can add to a bound
    bound = sizes * (1 - 1e-9) - 2 * (norms @ their.T)

    def exact(rows, j) -> np.ndarray:
        apart = x[rows] - c[j]
        return (apart * apart).sum(-1)

    every = np.arange(len(x))
    best = bound.argmin(1)
    distance = exact(every, best)
    taken = np.ones(len(x), np.int32)
    first = best.copy()
    for j in range(len(c)):
        # compared as floats, rounded up, so that no pair is lost
        rows = np.flatnonzero((bound[:, j] <= distance.astype(float) * (1 + 1e-12)) & (first != j))
        if len(rows):
            own = exact(rows, np.full(len(rows), j))
            taken[rows] += 1
            better = (own < distance[rows]) | ((own == distance[rows]) & (j < best[rows]))
            best[rows[better]], distance[rows[better]] = j, own[better]
    return best, distance, taken


def kept_vectors(embeddings: DataFrame, *, id_col: str, vector_col: str, dim: int, scale: int, segment: int) -> DataFrame:
    """id, x (floor(scale * entry)), norms (of its segments): vectors of `dim` entries, all finite, whose x are longs."""
    kind = embeddings.schema[id_col].dataType.simpleString()

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts, whole = vectors(batch.column("v"))
            rows = np.flatnonzero(whole & (np.diff(starts) == dim))
            flat = values[(starts[rows][:, None] + np.arange(dim)).astype(np.int64)]
            fits = (np.abs(flat) < LONG / (2 * scale)).all(1)
            rows, x = rows[fits], floors(flat[fits], scale)
            lists = [pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], pa.array(y.ravel())) for y in (x.astype(np.int64), segment_norms(x, segment))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), *lists], ["id", "x", "norms"])

    return embeddings.select(embeddings[id_col].alias("id"), embeddings[vector_col].alias("v")).mapInArrow(prepare, f"id {kind}, x array<long>, norms array<double>")


def _matrices(batch: pa.RecordBatch, dim: int, segment: int) -> tuple[np.ndarray, np.ndarray]:
    flat = lambda c, d: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return flat("x", dim), flat("norms", -(-dim // segment))


def _sums(kept: DataFrame, centroids: np.ndarray, segment: int) -> tuple[dict, dict]:
    """Vectors of each centroid, and the sums of their entries: for each (centroid, entry); what comes to the driver is k times the dimension."""
    k, dim = centroids.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dim), dtype=object), np.zeros(k, np.int64)
        for batch in batches:
            x, norms = _matrices(batch, dim, segment)
            if len(x):
                best, _, _ = nearest(x, norms, centroids, segment)
                x = x if largest(x) < LONG // len(x) else x.astype(object)
                order = np.argsort(best, kind="stable")
                own, at = np.unique(best[order], return_index=True)
                total[own] += np.add.reduceat(x[order], at, axis=0).astype(object)
                count += np.bincount(best, minlength=k)
        found = np.repeat(np.flatnonzero(count), dim)
        parts = digits(total[count > 0].ravel())
        for d, values in enumerate([count[count > 0], *parts], -1):
            of = np.flatnonzero(count) if d < 0 else found
            entry = np.zeros(len(of), np.int32) if d < 0 else np.tile(np.arange(dim, dtype=np.int32), len(of) // dim)
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(entry), pa.array(np.full(len(of), d, np.int32)), pa.array(values, pa.int64())], ["j", "entry", "digit", "value"])

    rows = kept.mapInArrow(add, "j int, entry int, digit int, value long").groupBy("j", "entry", "digit").agg(F.sum("value").alias("value")).collect()
    counts = {r["j"]: r["value"] for r in rows if r["digit"] < 0}
    return counts, from_digits(((r["j"], r["entry"]), r["digit"], r["value"]) for r in rows if r["digit"] >= 0)


def _moved(kept: DataFrame, centroids: np.ndarray, segment: int) -> np.ndarray:
    """Each centroid as floor(sum / count) of the vectors nearest to it; one without any stays."""
    counts, sums = _sums(kept, centroids, segment)
    out = centroids.copy()
    for j, n in counts.items():
        out[j] = [sums[j, i] // n for i in range(centroids.shape[1])]
    return out


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The `k` vectors of least SHA-256 of seed:id, of equals those of least entries; rows without an id come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = kept.select(digest.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def cluster(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, scale: int = 64, segment: int = SEGMENT
) -> tuple[DataFrame, np.ndarray]:
    """A row per vector, and the final centroids (k rows of integers; fewer where there are fewer vectors).

    Columns: id, cluster, distance (exact, squared; NULL beyond a long), n_exact (centroids that
    screening left to be measured), cluster_inertia and inertia (sums of the distances; NULL beyond a
    long), centroid_sha256. Vectors that are null, of other than `dim` entries, or have an entry that is
    null, not finite or so large that no long holds its integer, are left out; a table without any
    others gives no rows. Repeated rows, and rows without an id, count and stay each by itself.
    Other columns aren't looked at.
    """
    kind = embeddings.schema[id_col].dataType.simpleString()
    spark = embeddings.sparkSession
    kept = Rounds(spark).write(kept_vectors(embeddings, id_col=id_col, vector_col=vector_col, dim=dim, scale=scale, segment=segment))
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        empty = "cluster int, distance long, n_exact int, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"`{id_col}` {kind}, {empty}"), centroids
    for _ in range(rounds):
        centroids = _moved(kept, centroids, segment)
    final = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, norms = _matrices(batch, dim, segment)
            best, distance, taken = nearest(x, norms, final, segment)
            far = pa.array([str(d) for d in distance] if distance.dtype == object else distance).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype(np.int32)), far, pa.array(taken)], ["id", "cluster", "distance", "n_exact"])

    found = kept.mapInArrow(assign, f"id {kind}, cluster int, distance string, n_exact int")
    long = lambda c: F.expr(f"try_cast({c} as long)")
    found = Rounds(spark).write(found.withColumn("distance", long("distance")))
    # a row for each centroid: k bounds what comes here and what is joined
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.max(F.col("distance").isNull()).alias("beyond")).collect()
    by_cluster = {r["cluster"]: None if r["beyond"] else int(r["s"]) for r in sums}
    fits = lambda v: v if v is not None and v < 1 << 63 else None
    total = None if None in by_cluster.values() else sum(by_cluster.values())
    rows = [(j, fits(by_cluster.get(j)), fits(total), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(about), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "n_exact", "cluster_inertia", "inertia", "centroid_sha256"), centroids
