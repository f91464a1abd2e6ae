"""Embedding whitening by mixed-precision eigenvectors of the distributed covariance.

1. Vectors become whole numbers, floor(`SCALE` * entry) + `SHIFT`; the fit list holds each distinct one
   once. Count and sums are exact integers.
2. `moments`: every task multiplies its centred rows with themselves; the partial matrices are added
   per matrix row in Spark, in two rounds. The driver sees one dimension-by-dimension matrix.
3. `eigen`: float32 eigenvectors, corrected by Ogita and Aishima's iteration: a few matrix products in
   higher precision double the right digits each time. Eigenvalues too close for it form clusters,
   whose invariant subspaces are solved by themselves, shifted to the cluster's mean.
4. Every row is projected; a last pass over the fit list measures how far its covariance is from one.

Defined cases: vectors that are null, empty, or hold null, NaN or infinite entries are left out, as
are those whose length is not the commonest one (of lengths equally common: the larger). Entries
beyond `LIMIT` / SCALE in size are taken as that. Repeated rows and vectors give repeated rows and
count once in the fit. Components whose eigenvalue is zero but for rounding do not exist, so a fit
list of one vector gives no component and an empty array. `deviation` is null beyond a long.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from idsignal.llm.common import packed
from idsignal.workspace import stage

SCALE, SHIFT = 64, 1_000_000
LIMIT = 1 << 40
COMPONENTS = 16
WIDE_DIMENSIONS = 256  # up to here products run in long double, beyond in double
ROUNDS = 30
MERGES = 32


def usable(vector: Column) -> Column:
    """Neither null nor empty, no null, NaN or infinite entry."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & sound


def whole(vector: Column) -> Column:
    """Entries as whole numbers less `SHIFT`."""
    def entry(x: Column) -> Column:
        return F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("long")

    return F.transform(vector, entry)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def added(partials: DataFrame) -> DataFrame:
    """Sums of `values` per `line`, over rows (part, line, values): in groups of parts, then of those."""

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("part").to_numpy(), kind="stable")
        values = np.array(table.column("values").to_pylist(), float)[order].sum(0)
        return pa.table({"part": table.column("part").slice(0, 1), "line": table.column("line").slice(0, 1),
                         "values": pa.array([values], pa.list_(pa.float64()))})

    schema = "part int, line int, values array<double>"
    some = partials.withColumn("part", F.col("part") % MERGES).groupBy("part", "line").applyInArrow(add, schema)
    return some.groupBy("line").applyInArrow(add, schema)


def gram(rows: DataFrame, width: int, prepare: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of outer products of the prepared rows of column `x`; `width` wide once prepared."""

    def run(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                part = prepare(batch.column("x"))
                total = part.T @ part if total is None else total + part.T @ part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(total), pa.int32()),
                                              pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))],
                                             ["part", "line", "values"])

    found = added(rows.select("x").mapInArrow(run, "part int, line int, values array<double>")).collect()
    made = np.zeros((width, width))
    for row in found:
        made[row["line"]] = row["values"]
    return (made + made.T) / 2


def totals(rows: DataFrame, width: int) -> tuple[int, list[int], int]:
    """Rows, exact sum per dimension, largest size of an entry, of column `x`."""

    def run(batches):
        n, sums, top = 0, [0] * width, 0
        for batch in batches:
            x = matrix(batch.column("x"), width)
            n += len(x)
            # entries are below 2^40 and batches below 2^20 rows, so 64 bits hold a batch's sums
            for at in range(0, len(x), 1 << 20):
                sums = [a + int(b) for a, b in zip(sums, x[at:at + (1 << 20)].sum(0))]
            top = max(top, int(np.abs(x).max()) if len(x) else 0)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([top], pa.int64()), pa.array([[str(s) for s in sums]])],
                                         ["n", "top", "sums"])

    partial = rows.select("x").mapInArrow(run, "n long, top long, sums array<string>")
    whole_part = partial.select("n", "top", F.posexplode("sums").alias("line", "value"))
    found = whole_part.groupBy("line").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.sum(F.col("value").cast("decimal(38,0)")).alias("sum")).collect()
    sums = {r["line"]: int(r["sum"]) for r in found}
    return found[0]["n"], [sums[i] for i in range(width)], max(r["top"] for r in found)


def clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other within `near`, in groups of two or more."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order].astype(float)) > near) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def eigen(covariance: np.ndarray, wide_up_to: int = WIDE_DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    size = len(covariance)
    wide = np.longdouble if size <= wide_up_to else np.float64
    scale = float(np.abs(covariance).max()) or 1.0
    a = (covariance / scale).astype(wide)
    x = np.linalg.eigh((covariance / scale).astype(np.float32))[1].astype(wide)
    one, tiny = np.eye(size, dtype=wide), float(np.linalg.norm(covariance / scale)) * np.finfo(np.float64).eps

    def turned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distance of x from orthogonal, the matrix in its axes, eigenvalues."""
        off, inner = one - x.T @ x, x.T @ a @ x
        return off, inner, np.diag(inner) / (1 - np.diag(off))

    def error(off: np.ndarray, inner: np.ndarray) -> tuple[float, float]:
        return float(np.abs(inner - np.diag(np.diag(inner))).max()), float(np.abs(off).max())

    for _ in range(ROUNDS):
        x = x + x @ (one - x.T @ x) / 2
        off, inner, values = turned(x)
        if max(error(off, inner)) <= 8 * tiny:
            break
        # eigenvalues nearer than the digits still wrong cannot be told apart by the iteration
        near = 2 * float(np.linalg.norm((inner - np.diag(values)).astype(float))) + 2 * float(np.linalg.norm(off.astype(float)))
        groups = clusters(values, near)
        for group in groups:
            middle = values[group].mean()
            small = (inner[np.ix_(group, group)] - middle * one[np.ix_(group, group)]).astype(float)
            x[:, group] = x[:, group] @ np.linalg.eigh((small + small.T) / 2)[1].astype(wide)
        if groups:
            x = x + x @ (one - x.T @ x) / 2
            off, inner, values = turned(x)
        gap = values[None, :] - values[:, None]
        wrong = inner - np.diag(values) + off * values
        told_apart = np.abs(gap) > np.maximum(100 * np.abs(wrong), tiny)
        x = x + x @ np.where(told_apart, wrong / np.where(told_apart, gap, 1), off / 2)
    for _ in range(3):
        x = x + x @ (one - x.T @ x) / 2
    values = turned(x)[2]
    order = np.argsort(-values.astype(float), kind="stable")
    x, values = x[:, order].astype(float), values[order].astype(float) * scale
    heads = x[np.abs(x).argmax(0), np.arange(size)]
    return values, x * np.where(heads < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What the fit found: rows, dimension, exact sums, eigenvalues, vectors, trace, largest entry."""

    n: int
    width: int
    sums: list[int]
    top: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, the numerators exact."""
        return self.numerators(x).astype(float) / self.n

    def numerators(self, x: np.ndarray) -> np.ndarray:
        large = 2 * self.n * max(self.top, 1) >= 1 << 62
        return x.astype(object) * self.n - np.array(self.sums, object) if large else x * self.n - np.array(self.sums, np.int64)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        rows = self.numerators(x)
        if self.width * (2 * self.n * max(self.top, 1)) ** 2 >= 1 << 63:
            exact = [sum(int(v) ** 2 for v in row) for row in rows]
            return [v if v < 1 << 63 else None for v in exact]
        return (rows * rows).sum(1).tolist()


def whole_rows(rows: DataFrame, carry: list[str], vector: str = "embedding") -> tuple[DataFrame, int]:
    """(doc, x) of the usable rows of the commonest length, and that length (0: there are none)."""
    kept = rows.select(packed(rows.select(*[f"`{c}`" for c in carry])).alias("doc"), F.col(f"`{vector}`").alias("vector")).where(usable(F.col("vector")))
    lengths = kept.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    width = lengths["size"] if lengths else 0
    return kept.where(F.size("vector") == width).select("doc", whole(F.col("vector")).alias("x")), width


def fit(x: DataFrame, width: int, components: int = COMPONENTS, name: str = "whitening") -> tuple[Whitening | None, DataFrame | None]:
    """The whitening of the distinct vectors of column `x`, and the staged fit list; None for an empty table."""
    if not width:
        return None, None
    listed = stage(x.select("x").distinct(), f"{name}-fit")
    n, sums, top = totals(listed, width)
    made = Whitening(n, width, sums, top, np.zeros(0), np.zeros((width, 0)), 0.0)
    covariance = gram(listed, width, lambda column: made.centred(matrix(column, width))) / n
    values, vectors = eigen(covariance)
    real = int((values > max(values[0], 0) * width * 16 * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    keep = min(components, real)
    return Whitening(n, width, sums, top, values[:keep], vectors[:, :keep], float(np.trace(covariance))), listed


def identity_error(made: Whitening, listed: DataFrame) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, in size."""
    keep = len(made.values)
    if not keep:
        return 0.0
    return float(np.abs(gram(listed, keep, lambda column: made.project(matrix(column, made.width))) / made.n - np.eye(keep)).max())


def whiten(rows: DataFrame, carry: list[str], vector: str = "embedding", components: int = COMPONENTS, name: str = "whitening") -> DataFrame:
    """(doc, n, deviation, whitened, explained, identity_error) per usable row; arrays by component."""
    x, width = whole_rows(rows, carry, vector)
    made, listed = fit(x, width, components, name)
    schema = f"doc {x.schema['doc'].dataType.simpleString()}, deviation long, whitened array<double>"
    if made is None:
        given, explained, error, n = rows.sparkSession.createDataFrame([], schema), [], 0.0, 0
    else:
        def run(batches):
            for batch in batches:
                numbers = matrix(batch.column("x"), made.width)
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(made.deviation(numbers), pa.int64()),
                                                  pa.array(list(made.project(numbers)), pa.list_(pa.float64()))], ["doc", "deviation", "whitened"])

        given, n = x.mapInArrow(run, schema), made.n
        explained, error = (made.values / made.trace).tolist() if len(made.values) else [], identity_error(made, listed)
    return given.select("doc", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                        F.lit(explained).cast("array<double>").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
