"""Whitening of embeddings with covariances by polarisation.

The covariance of two dimensions follows from three variances: 2 cov(i, j) = var(x_i + x_j) - var(x_i) - var(x_j). So only squares of single values
are summed, one for every dimension and one for every pair of dimensions. Entries are whole numbers, x = floor(scale * c) + shift; they are centred at
the whole number below each mean before anything is squared, and all sums are exact integers. What the rounded centre leaves over is taken out at the
end in exact fractions, so the covariance matrix is right to the last bit of a double before ``eigh`` sees it.

Each task sums its rows block by block and gives one row of partial sums for each dimension and pair, cut into limbs of 30 bits, which Spark adds.
Only matrices of dimensions x dimensions reach the driver. A value too large for 62 bits of ``scale * c`` is taken at that bound.

Rows whose vector is null, or holds null or non-finite entries, are left out. The widest vector among the others gives the number of dimensions; a shorter one
lacks entries, which counts as null entries. A repeated row counts as often as it stands there; a null vec_id stays null. Components with no variance
(all of them if the rows are equal) have null ``whitened`` values and no part in ``identity_error``. ``deviation`` is null where the exact sum passes the
range of a long. Ties among eigenvalues leave a choice of axes; all rows get the same one. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
LIMIT = 1 << 62
BLOCK = 4096  # rows summed at once
LIMB = 30
SUMS = "what string, i int, j int, limb int, value long"


def vectors(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that can be used, all of the widest width."""
    entries = F.col(f"`{column}`").cast("array<double>")
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), entries.alias("embedding")).filter(entries.isNotNull() & sound)
    width = rows.agg(F.max(F.size("embedding")).alias("w")).first()["w"] or 0
    return rows.filter((F.size("embedding") == width) & (F.size("embedding") > 0))


def whole(batch: pa.RecordBatch, scale: int, shift: int) -> np.ndarray:
    """The whole-number vectors of a batch, one row each."""
    column = batch.column("embedding")
    flat = np.clip(np.floor(scale * column.flatten().to_numpy()), -float(LIMIT), float(LIMIT))
    return flat.astype(np.int64).reshape(len(column), -1) + shift


def _limbs(what: str, i: int, j: int, total: int) -> Iterator[tuple]:
    sign, total, k = (-1 if total < 0 else 1), abs(total), 0
    while total or not k:
        yield what, i, j, k, sign * (total & (1 << LIMB) - 1)
        total, k = total >> LIMB, k + 1


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["what", "i", "j", "limb", "value"])


def _total(partial: DataFrame) -> dict[tuple, int]:
    """Limbs added by Spark, put together again; as many entries as there are dimensions and pairs."""
    out: dict[tuple, int] = {}
    for r in partial.groupBy("what", "i", "j", "limb").agg(F.sum("value").alias("value")).collect():
        key = (r["what"], r["i"], r["j"])
        out[key] = out.get(key, 0) + (r["value"] << LIMB * r["limb"])
    return out


def _sum_of(squares: np.ndarray) -> list[int]:
    return [int(x) for x in squares.sum(axis=0)]


def value_sums(rows: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """The number of vectors and the sum of each dimension."""
    def run(batches):
        n, sums = 0, None
        for batch in batches:
            x = whole(batch, scale, shift)
            for a in range(0, len(x), BLOCK):
                own = x[a:a + BLOCK]
                part = _sum_of(own) if np.abs(own).max() < LIMIT >> 13 else _sum_of(own.astype(object))
                sums = part if sums is None else [s + p for s, p in zip(sums, part, strict=True)]
                n += len(own)
        if n:
            yield _frame([*_limbs("n", 0, 0, n), *(limb for i, s in enumerate(sums) for limb in _limbs("sum", i, i, s))])

    found = _total(rows.select("embedding").mapInArrow(run, SUMS))
    return found.pop(("n", 0, 0), 0), [found[k] for k in sorted(found)]


def squared_sums(rows: DataFrame, centre: list[int], scale: int, shift: int) -> dict[tuple[int, int], int]:
    """Exact sums of ((x_i - c_i) + (x_j - c_j))^2 for i < j, and of (x_i - c_i)^2 as (i, i)."""
    def run(batches):
        at, totals = np.array(centre, dtype=np.int64), None
        for batch in batches:
            x = whole(batch, scale, shift)
            for a in range(0, len(x), BLOCK):
                y = x[a:a + BLOCK]
                # 2^24 in size: pair sums below 2^25, squares below 2^50, so a block of 2^12 stays below 2^63
                small = max(int(y.max()) - min(centre), max(centre) - int(y.min())) < 1 << 24
                y = np.ascontiguousarray((y - at).T) if small else np.ascontiguousarray((y.astype(object) - np.array(centre, dtype=object)).T)
                part = []
                for i in range(len(y)):
                    both = y[i:] + y[i]
                    both[0] = y[i]
                    part.append((both * both).sum(axis=1) if not small else np.einsum("ij,ij->i", both, both))
                totals = totals if totals is not None else [[0] * (len(y) - i) for i in range(len(y))]
                for own, new in zip(totals, part, strict=True):
                    for k, v in enumerate(new.tolist()):
                        own[k] += v
        if totals is not None:
            yield _frame([limb for i, own in enumerate(totals) for k, v in enumerate(own) for limb in _limbs("square", i, i + k, v)])

    return {(i, j): v for (_, i, j), v in _total(rows.select("embedding").mapInArrow(run, SUMS)).items()}


def covariance(n: int, sums: list[int], centre: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix, each entry rounded once from its exact fraction."""
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]

    def spread(i: int, j: int) -> int:  # n^2 times the variance of dimension i, or of the sum of two
        return n * squares[i, j] - (rest[i] + rest[j] if i != j else rest[i]) ** 2

    single = [spread(i, i) for i in range(len(sums))]
    out = np.empty((len(sums),) * 2)
    for i in range(len(sums)):
        for j in range(i, len(sums)):
            out[i, j] = out[j, i] = Fraction(single[i], n * n) if i == j else Fraction(spread(i, j) - single[i] - single[j], 2 * n * n)
    return out


class Whitening:
    """Mean and axes of a corpus of vectors."""

    def __init__(self, rows: DataFrame, scale: int = SCALE, shift: int = SHIFT):
        self.scale, self.shift = scale, shift
        self.n, self.sums = value_sums(rows, scale, shift)
        self.centre = [s // self.n for s in self.sums] if self.n else []
        self.covariance = covariance(self.n, self.sums, self.centre, squared_sums(rows, self.centre, scale, shift)) if self.n else np.empty((0, 0))
        values, axes = np.linalg.eigh(self.covariance)
        self.values, self.axes = values[::-1].copy(), axes[:, ::-1].copy()
        self.trace = float(np.trace(self.covariance))
        #: Below this an eigenvalue is rounding error of a matrix of this size.
        self.live = self.values > self.trace * np.finfo(float).eps * max(1, len(values))

    def explained(self, components: int) -> list[float | None]:
        return [float(v) / self.trace if self.trace else None for v in self.values[:components]]

    def applied(self, rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
        """(vec_id, deviation, whitened array) of each vector."""
        k, n, scale, shift, centre = min(components, len(self.values)), self.n, self.scale, self.shift, self.centre
        rest = [s - n * c for s, c in zip(self.sums, centre, strict=True)]
        axes = self.axes[:, :k] / np.sqrt(np.where(self.live[:k], self.values[:k], np.nan))

        def run(batches):
            at, left = np.array(centre, dtype=np.int64), np.array(rest, dtype=object)
            for batch in batches:
                x = whole(batch, scale, shift)
                if not len(x):
                    continue
                y = x - at if max(int(x.max()) - min(centre), max(centre) - int(x.min())) < LIMIT else x.astype(object) - np.array(centre, dtype=object)
                largest = int(np.abs(y).max()) + 1
                if n * largest < 1 << 52 and x.shape[1] * (n * largest) ** 2 < LIMIT:
                    far = n * y - left.astype(np.int64)
                    deviation = np.einsum("ij,ij->i", far, far).tolist()
                else:
                    far = n * y.astype(object) - left
                    deviation = [d if d < 1 << 63 else None for d in (far * far).sum(axis=1)]
                w = (y.astype(np.float64) - (left / n).astype(np.float64)) @ axes
                flat = pa.array(w.reshape(-1), pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), flat)], ["vec_id", "deviation", "whitened"])

        return rows.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, live: list[bool]) -> float | None:
    """The largest absolute entry of the covariance of the whitened values minus the identity, over components with variance."""
    chosen = np.flatnonzero(live)

    def run(batches):
        n, first, second = 0, 0.0, 0.0
        for batch in batches:
            column = batch.column("whitened")
            w = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)[:, chosen]
            n, first, second = n + len(w), first + w.sum(axis=0), second + w.T @ w
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(chosen)), *(len(chosen) + i for i in range(second.size))], pa.int32()), pa.array([float(n), *first, *second.reshape(-1)])], ["place", "value"])

    sums = {r["place"]: r["value"] for r in whitened.select("whitened").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()}
    if not sums or not len(chosen):
        return None
    k, n = len(chosen), sums[-1]
    mean = np.array([sums[i] for i in range(k)]) / n
    found = np.array([sums[k + i] for i in range(k * k)]).reshape(k, k) / n - np.outer(mean, mean)
    return float(np.abs(found - np.eye(k)).max())


def whitened(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, column: str = "embedding") -> DataFrame:
    """One row per vector and component: number of vectors, deviation, whitened value, explained share and the identity error."""
    rows = vectors(embeddings, column)
    model = Whitening(rows, scale, shift)
    values = stored(model.applied(rows, components), "whitened")
    error = identity_error(values, model.live[:components].tolist())
    shares = F.array(*[F.lit(s).cast("double") for s in model.explained(components)]) if len(model.values) else F.array().cast("array<double>")
    return values.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"), shares.alias("shares")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get("shares", F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
