"""Embedding whitening from an exact covariance, by digit-slice products.

Entries become integers x, and with their number n and sums S the centred vectors n x - S are
integers too. A task splits them into small limbs, so that a product of two blocks of limbs by BLAS
is exact in doubles, recombines the products of all pairs of limbs as big integers, and hands those
on as digits, which Spark adds. The covariance is thus exact before its one rounding to doubles;
its eigenvectors give the components that each row is projected on.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import LONG, digits, floors, from_digits, largest, vectors

LIMB = 18  # bits; products of two limbs have 36
BLOCK = 1 << 16  # rows of a product: their sum has 52 bits, which doubles hold exactly
_SUMS = "d int, i int, j int, digit int, value long"


def limbs(y: np.ndarray, bits: int = LIMB) -> list[np.ndarray]:
    """y as sum of limb k times 2 ** (bits k), as doubles: all limbs are below 2 ** bits, and the last has the sign."""
    count = max(1, -(-(largest(y).bit_length() + 1) // bits))
    low = [((y >> (bits * k)) & ((1 << bits) - 1)).astype(float) for k in range(count - 1)]
    return [*low, (y >> (bits * (count - 1))).astype(float)]


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y's transpose by y, in Python's integers."""
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    for a in range(0, len(y), BLOCK):
        parts = limbs(y[a : a + BLOCK])
        for i, p in enumerate(parts):
            for j in range(i + 1):
                product = (p.T @ parts[j]).astype(np.int64).astype(object) << (LIMB * (i + j))
                total += product if i == j else product + product.T
    return total


def _rows(batches: Iterator[pa.RecordBatch], scale: int, plus: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """For each batch and each length of whole vectors in it: the batch, numbers of rows, their x, the length."""
    for batch in batches:
        values, starts, whole = vectors(batch.column("v"))
        size = np.diff(starts)
        for d in np.unique(size[whole & (size > 0)]).tolist():
            rows = np.flatnonzero(whole & (size == d))
            yield batch, rows, floors(values[starts[rows][:, None] + np.arange(d)], scale, plus), d


def _handed_on(found: dict[tuple[int, int], dict[tuple[int, int], int]]) -> Iterator[pa.RecordBatch]:
    rows = [(d, i, j, k, int(v)) for (d, i), of in found.items() for j, value in of.items() for k, v in enumerate(_split(value))]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32()] * 4 + [pa.int64()], strict=True)], ["d", "i", "j", "digit", "value"])


def _split(value: int) -> list[int]:
    return [int(x[0]) for x in digits(np.array([value], dtype=object))]


class Centre:
    """The number of vectors, and their sums."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        fits = self.n * (largest(x) + 1) < LONG and max(map(abs, self.sums)) < LONG
        return x * self.n - np.array(self.sums) if fits else x.astype(object) * self.n - np.array(self.sums, dtype=object)


class Fit(Centre):
    """What whitening needs of all vectors; a few numbers for each pair of dimensions."""

    def __init__(self, n: int, sums: list[int], gram: np.ndarray, components: int):
        """`gram` is that of the vectors n x - S, exact."""
        super().__init__(n, sums)
        covariance = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in gram])
        values, axes = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        axes = axes[:, order]
        self.axes = axes * np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0)[0] < 0, -1.0, 1.0)
        self.values = values[order]
        self.trace = float(Fraction(int(sum(gram[i, i] for i in range(len(gram)))), n**3))
        #: a component without variance can't be scaled to have one
        self.known = self.values > max(self.trace, 0.0) * len(gram) * np.finfo(float).eps

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Rows of the known components of centred vectors."""
        return (y.astype(float) / self.n) @ (self.axes[:, self.known] / np.sqrt(self.values[self.known]))


def _centred_rows(batches, scale, plus, centre: Centre, d: int):
    for batch, rows, x, own in _rows(batches, scale, plus):
        if own == d:
            yield batch, rows, centre.centred(x)


def whiten(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, plus: int = 1_000_000
) -> DataFrame:
    """A row for each vector and component: id, component (from 1, by falling variance), n, deviation, whitened, explained, identity_error.

    x is floor(scale * entry) + plus; `deviation` is the sum over dimensions of (n x - S)^2, exact, a
    decimal (NULL beyond 38 digits). `identity_error` is the largest entry of the covariance of what
    is returned, as measured, less the identity. Vectors that are null or have an entry that is null
    or not finite are left out, as are those of another length than the commonest (of equals the
    longer), which have no covariance with the others, and empty ones. Where there are fewer
    components with variance than asked for, as of few or alike vectors, the others have a NULL in
    `whitened` and don't count in `identity_error`. Repeated rows, and rows without an id, count and stay
    each by itself. An empty table gives no rows. Other columns aren't looked at.

    Three passes read the table before the last: n and sums, the covariance, the check; what comes to
    the driver is as many numbers as pairs of dimensions.
    """
    spark, kind = embeddings.sparkSession, embeddings.schema[id_col].dataType.simpleString()
    rows = embeddings.select(embeddings[id_col].alias("id"), embeddings[vector_col].alias("v"))
    schema = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for _, at, x, d in _rows(batches, scale, plus):
            sums = (x if largest(x) < LONG // len(x) else x.astype(object)).sum(0).astype(object)
            for i, s in enumerate([len(at), *sums]):
                own = found.setdefault((d, i - 1), {0: 0})
                own[0] += s
        yield from _handed_on(found)

    summed = rows.mapInArrow(add, _SUMS).groupBy("d", "i", "j", "digit").agg(F.sum("value").alias("value"))
    # the commonest length: of each length one row has its count, and only the sums of the one chosen come to the driver
    chosen = summed.where("i = -1").groupBy("d").agg(F.sum(F.col("value") * F.pow(F.lit(2.0), 32 * F.col("digit"))).alias("n")).orderBy(F.desc("n"), F.desc("d")).select("d").first()
    if chosen is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d = chosen["d"]
    totals = from_digits((r["i"], r["digit"], r["value"]) for r in summed.where(F.col("d") == d).collect())
    n, sums = totals[-1], [totals[i] for i in range(d)]

    centre = Centre(n, sums)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), dtype=object)
        for _, _, y in _centred_rows(batches, scale, plus, centre, d):
            total += exact_gram(y)
        if total.any():
            yield from _handed_on({(d, i): {j: total[i, j] for j in range(i + 1)} for i in range(d)})

    parts = rows.mapInArrow(multiply, _SUMS).groupBy("i", "j", "digit").agg(F.sum("value").alias("value")).collect()
    cells = from_digits(((r["i"], r["j"]), r["digit"], r["value"]) for r in parts)
    fit = Fit(n, sums, np.array([[cells.get((max(i, j), min(i, j)), 0) for j in range(d)] for i in range(d)], dtype=object), components)
    count, known = len(fit.values), int(fit.known.sum())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((known, known))
        for _, _, y in _centred_rows(batches, scale, plus, fit, d):
            z = fit.whitened(y)
            total += z.T @ z
        i, j = np.tril_indices(known)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "value"])

    measured = rows.mapInArrow(check, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    error = measured.agg(F.max(F.abs(F.col("value") / F.lit(float(n)) - (F.col("i") == F.col("j")).cast("double"))).alias("e")).first()["e"]
    explained = np.where(fit.known, fit.values / (fit.trace or 1.0), 0.0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, y in _centred_rows(batches, scale, plus, fit, d):
            for a in range(0, len(at), 2_000):  # as many rows times components are handed on at once
                part, own = y[a : a + 2_000], at[a : a + 2_000]
                short = largest(part) ** 2 * d < LONG
                apart = pa.array([str(v) if v < 10**38 else None for v in ((part if short else part.astype(object)) ** 2).sum(1).tolist()], pa.string())
                z = np.full((len(own), count), np.nan)
                z[:, fit.known] = fit.whitened(part)
                take = pa.array(np.repeat(np.arange(len(own)), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(own)).take(take), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(own))), apart.take(take),
                        pa.array(z.ravel(), from_pandas=True), pa.array(np.tile(explained, len(own))),
                    ],
                    ["id", "component", "deviation", "whitened", "explained"],
                )

    out = rows.mapInArrow(project, f"id {kind}, component int, deviation string, whitened double, explained double")
    return out.select(
        F.col("id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", F.lit(error).cast("double").alias("identity_error")
    )
