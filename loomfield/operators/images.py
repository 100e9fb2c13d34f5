"""Images as arrays in rows: fingerprints, texture and pixel digests, in bulk over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE, BITS = 32, 64


def coefficients(n: int = BITS) -> list[tuple[int, int]]:
    """The first n (horizontal, vertical) frequencies on a zig-zag over the diagonals, without the constant one:
    odd diagonals are walked towards higher horizontal frequencies, even ones back."""
    out: list[tuple[int, int]] = []
    diagonal = 1
    while len(out) < n:
        step = [(u, diagonal - u) for u in range(diagonal + 1)]
        out += step if diagonal % 2 else step[::-1]
        diagonal += 1
    return out[:n]


def cosine_basis(side: int = SIDE) -> np.ndarray:
    """Row f: the orthonormal cosine of frequency f at the side's places."""
    f, at = np.arange(side)[:, None], 2 * np.arange(side) + 1
    return np.sqrt(np.where(f == 0, 1, 2) / side) * np.cos(np.pi * at * f / (2 * side))


def _bits(values: np.ndarray) -> np.ndarray:
    """Per row, which values are above the mean of the two middle ones."""
    middle = np.sort(values, axis=1)
    half = values.shape[1] // 2
    return values > ((middle[:, half - 1] + middle[:, half]) / 2)[:, None]


def _summed_exactly(luma: np.ndarray, basis: np.ndarray, places: list[tuple[int, int]]) -> np.ndarray:
    """Coefficients of one image by sums that round once: for images whose bits hang on rounding."""
    mean = math.fsum(luma.tolist()) / luma.size
    rows = (luma.reshape(SIDE, SIDE) - mean).tolist()
    across = {u: [math.fsum(x * y for x, y in zip(r, basis[u].tolist(), strict=True)) for r in rows] for u in {u for u, _ in places}}
    return np.array([math.fsum(x * y for x, y in zip(across[u], basis[v].tolist(), strict=True)) for u, v in places])


def luma_bits(luma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of images (n, 1024) as they are and flipped left to right. Both come from one transform of two
    matrix products: a flip changes the sign of odd horizontal frequencies. Where a value is so close to the
    threshold that the order of additions could decide its bit, it is summed again exactly."""
    places, basis = coefficients(), cosine_basis()
    u, v = np.array(places).T
    centered = luma.reshape(-1, SIDE, SIDE) - luma.mean(axis=1)[:, None, None]
    values = (basis @ centered @ basis.T)[:, v, u]
    sign = np.where(u % 2, -1.0, 1.0)
    close = np.zeros(len(values), bool)
    for turned in (values, values * sign):
        middle = np.sort(turned, axis=1)[:, BITS // 2 - 1 : BITS // 2 + 1]
        gap = np.abs(turned - middle.mean(axis=1)[:, None]).min(axis=1)
        close |= gap <= 1e-9 * (1 + np.abs(turned).max(axis=1))
    for k in np.flatnonzero(close):
        values[k] = _summed_exactly(luma[k], basis, places)
    return _bits(values), _bits(values * sign)


def luma_fingerprints(rows: DataFrame, id_col: str, luma_col: str) -> DataFrame:
    """rows(id, 1,024 luma values from 0 to 255 by row: an array, or as many bytes) -> (id, orientations), as
    neardup.near_pairs() takes them with 4 words of 16 bits: o 0 is the image, 1 its mirror image. Rows with
    a null image or a null in it are left out; images of another size are an error."""
    binary = rows.schema[luma_col].dataType.typeName() == "binary"
    luma = F.col(luma_col) if binary else F.col(luma_col).cast("array<double>")
    live = rows.select(F.col(id_col).alias("id"), luma.alias("luma")).filter(F.col("luma").isNotNull())
    if not binary:
        live = live.filter(F.forall("luma", lambda x: x.isNotNull() & ~F.isnan(x)))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(16, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            if binary:
                images = [np.frombuffer(x, np.uint8).astype(np.float64) for x in batch.column(1).to_pylist()]
            else:
                images = [x.to_numpy(zero_copy_only=False) for x in (s.values for s in batch.column(1))]
            if any(len(x) != SIDE * SIDE for x in images):
                raise ValueError("an image must have 32 times 32 luma values")
            words = [(b.reshape(-1, 4, 16) * weights).sum(axis=2) for b in luma_bits(np.stack(images))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(w.tolist(), pa.list_(pa.int64())) for w in words)], names=["id", "same", "flipped"])

    found = live.mapInArrow(run, f"id {kind}, same array<long>, flipped array<long>")
    each = F.array(F.struct(F.lit(0).alias("o"), F.col("same").alias("words")), F.struct(F.lit(1).alias("o"), F.col("flipped").alias("words")))
    return found.select("id", each.alias("orientations"))


#: Fixed value: the neighbours of a pixel as (down, right), from the lowest bit of its code on.
AROUND = ((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))


def binary_patterns(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Counts of the 256 codes of inner pixels (bit k: neighbour k is as bright or brighter) whose whole
    neighbourhood is in the mask, for one image (height, width)."""
    high, wide = image.shape
    if min(high, wide) < 3:
        return np.zeros(256, np.int64)
    inner = lambda x, down, right: x[1 + down : high - 1 + down, 1 + right : wide - 1 + right]
    centre, code, whole = inner(image, 0, 0), np.zeros((high - 2, wide - 2), np.int64), inner(mask, 0, 0).copy()
    for k, (down, right) in enumerate(AROUND):
        code |= (inner(image, down, right) >= centre).astype(np.int64) << k
        whole &= inner(mask, down, right)
    return np.bincount(code[whole], minlength=256)


def texture_histograms(rows: DataFrame, id_col: str, luma_col: str, width_col: str, mask_col: str | None = None) -> DataFrame:
    """rows(id, luma array by row, width, mask array of booleans) -> (id, pixels, histogram): shares of the 256
    local binary patterns among the inner pixels whose neighbourhood is in the mask; all zero where there are
    none. Rows with a null image or width are left out, a null in the mask (or no mask where one is named) is
    out of it; values that are null or not finite, and sizes that do not fit, are errors."""
    mask = F.lit(None).cast("array<boolean>") if mask_col is None else F.coalesce(F.transform(mask_col, lambda x: F.coalesce(x.cast("boolean"), F.lit(False))), F.array().cast("array<boolean>"))
    live = rows.select(F.col(id_col).alias("id"), F.col(luma_col).cast("array<double>").alias("luma"), F.col(width_col).cast("int").alias("width"), mask.alias("mask"))
    live = live.filter("luma IS NOT NULL AND width IS NOT NULL")
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.zeros((batch.num_rows, 256), np.int64)
            for k, (luma, width, mask) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3), strict=True)):
                values = luma.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if width < 1 or len(values) % width or not np.isfinite(values).all():
                    raise ValueError("an image must be finite values, a multiple of its width")
                image = values.reshape(-1, width)
                inside = np.ones(image.shape, bool)
                if mask.is_valid:
                    given = mask.values.to_numpy(zero_copy_only=False).astype(bool)
                    if len(given) not in (0, len(values)):
                        raise ValueError("a mask must be as large as its image")
                    inside = given.reshape(image.shape) if len(given) else np.zeros(image.shape, bool)
                counts[k] = binary_patterns(image, inside)
            total = counts.sum(axis=1)
            share = counts / np.maximum(total, 1)[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(share.tolist(), pa.list_(pa.float64()))], names=["id", "pixels", "histogram"])

    return live.mapInArrow(run, f"id {kind}, pixels long, histogram array<double>")


def pixel_digest(height: Column, width: Column, rgb: Column) -> Column:
    """SHA-256 of an image's content: its height and width as four big-endian bytes each, then its bytes (three a
    pixel, by row). Null if any of them is, or if the bytes do not fill the image."""
    size = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))
    whole = F.length(rgb) == 3 * height.cast("long") * width.cast("long")
    return F.when(whole, F.sha2(F.concat(size(height), size(width), rgb), 256))
