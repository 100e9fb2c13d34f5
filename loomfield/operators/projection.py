"""Principal axes of tall tables, and rows on them.

Axes come from block power iteration: a pass multiplies the centred table with a few directions and back,
X'(XQ), where each task adds up its batches, so that a row for each component leaves it. The driver
holds as many numbers as components times directions, and makes the directions orthonormal. Passes go on
until the variances along the wanted axes settle; variances too close to tell apart get more directions, and with
as many as components one pass is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions.vectors import as_double, usable
from loomfield.storage import stored


WIDEST = 1024  # directions at once: the driver holds components times directions, twice


@dataclass(frozen=True)
class Axes:
    """Axes as rows of `directions`, largest variance first, each with its component of largest size
    positive (ties: the first); scale divides the centred components."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    variance: np.ndarray
    share: np.ndarray
    rows: int
    passes: int


def _matrix(lists: pa.Array, size: int) -> np.ndarray:
    at = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    if len(values) != len(lists) * size or (np.diff(at) != size).any():
        raise ValueError(f"vectors must have {size} components")
    return values.reshape(-1, size)


def _sums(rows: DataFrame, size: int, columns: int, work) -> np.ndarray:
    """(size, columns): the sum of work(batch matrix) over all batches; a task hands on one row a component."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, columns))
        for batch in batches:
            if batch.num_rows:
                total += work(_matrix(batch.column(0), size))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), *(pa.array(c) for c in total.T)], names=["i", *(f"q{k}" for k in range(columns))])

    names = [f"q{k}" for k in range(columns)]
    parts = rows.mapInArrow(run, "i long, " + ", ".join(f"{n} double" for n in names))
    out = np.zeros((size, columns))
    for r in parts.groupBy("i").agg(*[F.sum(n).alias(n) for n in names]).collect():  # a row a component
        out[r[0]] = r[1:]
    return out


def principal_axes(rows: DataFrame, vector: str, k: int, scaled: bool = False, spare: int = 12, tolerance: float = 1e-10, most: int = 200, seed: int = 0) -> Axes:
    """The k axes of largest variance of the vectors (all of one length; null ones and those with components
    that are null or not finite take no part); scaled: of components divided by their standard deviation (those
    that do not vary by one). Iterates k + spare directions until no variance changes by more than tolerance of
    the largest, and twice as many after each 20 passes that did not settle, up to WIDEST. Vectors of up to twice k + spare
    components take all of them at once: one pass is exact then. `most` passes are an error: more than WIDEST
    directions are too close to tell apart. Variances are of the sample (n - 1); shares are of all variance."""
    v = stored(rows.select(as_double(vector).alias("v")).filter(usable(F.col("v"))), "vectors")
    first = v.select(F.size("v").alias("n")).first()
    if first is None or not first["n"] or k < 1:
        raise ValueError("principal axes take vectors with components, and k of at least one")
    size = first["n"]
    shift = np.array(v.first()["v"])  # any row: sums of squares about it lose less
    sums = _sums(v, size, 3, lambda x: np.stack([(x - shift).sum(axis=0), ((x - shift) ** 2).sum(axis=0), np.full(size, len(x))], axis=1))
    n = int(sums[0, 2])
    if n < 2:
        raise ValueError("principal axes take two vectors or more")
    mean, second = shift + sums[:, 0] / n, np.maximum(0, sums[:, 1] - sums[:, 0] ** 2 / n)
    deviation = np.sqrt(second / n)
    scale = np.where(deviation > 1e-12 * (1 + np.abs(mean)), deviation, 1.0) if scaled else np.ones(size)
    total = float((second / scale**2).sum())
    width = size if size <= 2 * (k + spare) else k + spare
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(size, width)))[0]
    before = np.full(width, np.inf)
    for done in range(1, most + 1):
        z = _sums(v, size, width, lambda x, q=q: ((y := (x - mean) / scale).T @ (y @ q)))
        turned, value, _ = np.linalg.svd(q.T @ z, hermitian=True)
        found = q @ turned
        if width == size or np.abs(value[:k] - before[:k]).max() <= tolerance * max(value[0], 1e-300):
            break
        more = min(size, 2 * width, WIDEST) - width if done % 20 == 0 else 0
        before, width = value, width + max(0, more)
        q = np.linalg.qr(np.hstack([z @ turned, rng.normal(size=(size, max(0, more))) * value[0]]))[0]
    else:
        raise ValueError(f"the variances did not settle in {most} passes with {width} directions")
    axes = found[:, : min(k, size)].T
    largest = np.argmax(np.round(np.abs(axes), 9), axis=1)
    axes = axes * np.where(axes[np.arange(len(axes)), largest] < 0, -1.0, 1.0)[:, None]
    value = np.maximum(0, value[: len(axes)])
    return Axes(mean, scale, axes, value / (n - 1), value / total if total > 0 else np.zeros(len(axes)), n, done)


def projected(rows: DataFrame, id_col: str, vector: str, axes: Axes) -> DataFrame:
    """(id, coordinates) of rows on the axes; null for a vector that is null, or has null or non-finite
    components. Others must have the axes' length."""
    size, kind = len(axes.mean), rows.schema[id_col].dataType.simpleString()
    own = as_double(vector)
    live = rows.select(F.col(id_col).alias("id"), F.when(usable(own), own).alias("v"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column(1).is_valid()
            out = ((_matrix(batch.column(1).filter(there), size) - axes.mean) / axes.scale) @ axes.directions.T
            found = iter(out.tolist())
            told = [next(found) if ok else None for ok in there.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.list_(pa.float64()))], names=["id", "coordinates"])

    return live.mapInArrow(run, f"id {kind}, coordinates array<double>")
