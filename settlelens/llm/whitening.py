"""Whitening of embeddings on their leading components, with FEAST as the eigensolver.

Vectors become whole numbers first. The fit list has each distinct vector once; its count, its sums and its
second moments are exact whole-number sums over the partitions (products are of entries less the rounded
mean, so they are centred before they are multiplied, and the fraction that rounding left is taken off
exactly), so the covariance has one rounding per entry and does not depend on how rows are dealt. It is
one small matrix, of the squared number of components; the driver finds its leading eigenpairs by contour
integration (``feast``). A last pass projects every row, and another over the fit list measures how far the
covariance of the whitened values is from the identity.

Edge cases. Rows go whose vector is null or has null, non-finite or huge entries (``vectors.integer_vectors``).
Vectors have one length; where lengths differ, the most frequent one stays, the larger on ties. A null id is
kept. Repeated rows count once in the fit list and each get their rows. Components without variance (their
eigenvalue at most a billionth of a billionth of the trace times the number of components) have no whitened value and get no rows; so a table
with one distinct vector, and an empty one, give an empty result. A deviation beyond the range of a long is
null there and whole in ``deviation_digits``. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlelens.llm.common import drop, written
from settlelens.llm.feast import largest_pairs
from settlelens.llm.vectors import integer_vectors, matrix, partition_sums

COMPONENTS = 4
LOW_BITS = 14

SCHEMA = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_digits string"
)


def _first_moments(width: int):
    def add(totals: dict, batch: pa.RecordBatch) -> None:
        x = matrix(batch["x"], width)
        totals[-1, -1] = totals.get((-1, -1), 0) + len(x)
        for i, v in enumerate(x.sum(axis=0).tolist()):
            totals[i, -1] = totals.get((i, -1), 0) + v

    return add


def _second_moments(mean: np.ndarray):
    """Exact sums of products of ``x - mean``. Entries are cut into two halves, whose products fit doubles."""
    width = len(mean)
    rows, cols = np.triu_indices(width)
    keys = list(zip(rows.tolist(), cols.tolist(), strict=True))

    def add(totals: dict, batch: pa.RecordBatch) -> None:
        y = matrix(batch["x"], width) - mean
        high = y >> LOW_BITS
        low = (y - (high << LOW_BITS)).astype(np.float64)
        high = high.astype(np.float64)
        whole = lambda m: m.astype(np.int64)[rows, cols].astype(object)
        cross = high.T @ low
        part = (whole(high.T @ high) << 2 * LOW_BITS) + (whole(cross + cross.T) << LOW_BITS) + whole(low.T @ low)
        for key, v in zip(keys, part.tolist(), strict=True):
            totals[key] = totals.get(key, 0) + v

    return add


def moments(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """(n, per-component sums, covariance with divisor n) of the vectors of ``fit``."""
    first = {r["a"]: int(r["total"]) for r in partition_sums(fit, width, _first_moments(width)).collect()}  # width + 1 rows
    n = first.get(-1, 0)
    sums = [first.get(i, 0) for i in range(width)]
    if not n:
        return 0, sums, np.zeros((width, width))
    mean = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, mean, strict=True)]
    second = partition_sums(fit, width, _second_moments(np.array(mean, dtype=np.int64))).collect()  # width * (width + 1) / 2 rows
    v = np.zeros((width, width))
    for r in second:
        i, j = r["a"], r["b"]
        v[i, j] = v[j, i] = (n * int(r["total"]) - rest[i] * rest[j]) / (n * n)  # whole numbers, rounded once
    return n, sums, v


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, from the exact difference to the rounded mean."""
    mean = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, mean, strict=True)])
    return (x - mean) - rest


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums over the components of (n x - S)^2, exact: as doubles are too short, products of whole numbers of Python."""
    mean = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, mean, strict=True)], dtype=object)
    y = x - mean
    # (n y - r)^2 summed is n^2 sum(y^2) - 2 n sum(r y) + sum(r^2).
    squares = np.einsum("ij,ij->i", y, y).astype(object)
    return (n * n * squares - 2 * n * (y.astype(object) @ rest) + int((rest * rest).sum())).tolist()


def _whiten(n: int, sums: list[int], basis: np.ndarray, explained: list[float], error: float):
    width, k = basis.shape
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch["x"], width)
            m = len(x)
            values = _centred(x, n, sums) @ basis
            digits = _deviation(x, n, sums)
            long = pa.array([d if d < 2**63 else None for d in digits], pa.int64())
            each = np.repeat(np.arange(m), k)
            fields = [
                batch["vec_id"].take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)),
                long.take(pa.array(each)),
                pa.array(values.ravel()),
                pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error)),
                pa.array([str(d) for d in digits]).take(pa.array(each)),
            ]
            yield pa.RecordBatch.from_arrays(fields, names)

    return run


def _whitened_moments(n: int, sums: list[int], basis: np.ndarray):
    width, k = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, size = np.zeros(k), np.zeros((k, k)), 0
        for batch in batches:
            w = _centred(matrix(batch["x"], width), n, sums) @ basis
            total, square, size = total + w.sum(axis=0), square + w.T @ w, size + len(w)
        yield pa.RecordBatch.from_pylist([{"size": size, "total": total.tolist(), "square": square.ravel().tolist()}])

    return run


def identity_error(fit: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> float:
    """The largest absolute entry of the whitened covariance over ``fit`` minus the identity."""
    k = basis.shape[1]
    parts = fit.mapInArrow(_whitened_moments(n, sums, basis), "size bigint, total array<double>, square array<double>")
    each = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(k)] + [F.sum(F.col("square")[i]).alias(f"s{i}") for i in range(k * k)]
    row = parts.agg(*each).first()
    # Values are centred by S/n before they are multiplied; what rounding left of their mean is taken off.
    mean = np.array([row[f"t{i}"] for i in range(k)]) / n
    found = np.array([row[f"s{i}"] for i in range(k * k)]).reshape(k, k) / n - np.outer(mean, mean)
    return float(np.abs(found - np.eye(k)).max())


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component (``SCHEMA``), components numbered from 1 by falling eigenvalue."""
    spark = vectors.sparkSession
    rows, rows_path = written(integer_vectors(vectors, id_col, vector_col), "whiten-rows")
    lengths = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None or not lengths["width"]:
        drop(spark, rows_path)
        return spark.createDataFrame([], SCHEMA)
    width = lengths["width"]
    rows = rows.where(F.size("x") == width)
    fit, fit_path = written(rows.select("x").distinct(), "whiten-fit")
    n, sums, v = moments(fit, width)
    values, axes = largest_pairs(v, min(components, width))
    trace = float(np.trace(v))
    used = values > trace * width * 1e-18
    basis = axes[:, used] / np.sqrt(values[used])
    if not used.any():
        drop(spark, rows_path, fit_path)
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(fit, n, sums, basis)
    drop(spark, fit_path)
    explained = (values[used] / trace).tolist()
    return rows.mapInArrow(_whiten(n, sums, basis, explained, error), SCHEMA)
