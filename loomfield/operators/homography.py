"""Candidate pairs held against geometry: does one plane-to-plane mapping explain their keypoint matches?

A pair is one row with its matches. Minimal sets of four are drawn by hash, all drawn sets of a pair are solved in closed
form and judged in one go, those in reach of the best again by singular vectors, the set with the most inliers is refitted on them until they no longer change, and the outcome
must be spread over both images and be a mapping that a camera could make. Pairs do not meet; they are
dealt evenly, and a task holds the matches of one pair times the sets that are judged at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Typed reasons; all but the first leave a pair open.
CONFIRMED = "CONFIRMED"
FEW_MATCHES, NO_MODEL, FEW_INLIERS = "TOO_FEW_MATCHES", "NO_MODEL", "TOO_FEW_INLIERS"
INEXACT, NO_SPREAD, DEGENERATE = "INLIERS_TOO_INEXACT", "INLIERS_NOT_SPREAD", "DEGENERATE_MAPPING"

MATCHES = "array<struct<x: double, y: double, u: double, v: double>>"
RESULT = "reason string, matches long, inliers long, inlier_ratio double, median_error double, p95_error double, mapping array<double>, inlier_places array<int>"


@dataclass(frozen=True)
class Limits:
    """Fixed values of the default policy; lengths are shares of an image's diagonal, areas of an image."""

    matches: int = 10
    inliers: int = 10
    inlier_ratio: float = 0.45
    reprojection: float = 0.004
    median_error: float = 0.006
    p95_error: float = 0.015
    hull_area: float = 0.025
    grid: int = 4
    cells: int = 4
    interior_margin: float = 0.05
    interior: float = 0.35
    eigen_ratio: float = 0.01
    singular_ratio: float = 0.05
    scales: tuple[float, float] = (0.05, 20.0)
    condition: float = 1e8
    denominator: float = 0.05
    area_ratios: tuple[float, float] = (0.01, 100.0)


def drawn_sets(name: str, seed: int, sets: int, n: int) -> np.ndarray:
    """(sets, 4) places below n, those of a row distinct: from SHA-256 of seed, name and set, alike everywhere.
    A place that is taken moves on to the next free one."""
    words = -(-sets // 2)
    raw = b"".join(hashlib.sha256(f"{seed}|{name}|{k}".encode()).digest() for k in range(words))
    at = np.frombuffer(raw, ">u4").reshape(-1, 4)[:sets].astype(np.int64) % (n - np.arange(4))
    for k in range(1, 4):
        before = np.sort(at[:, :k], axis=1)
        for j in range(k):
            at[:, k] += at[:, k] >= before[:, j]
    return at


def _normalized(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (..., n, 2) about their centre at a mean distance of the root of two, and the matrix that does it."""
    centre = points.mean(axis=-2, keepdims=True)
    spread = np.sqrt(((points - centre) ** 2).sum(axis=-1)).mean(axis=-1)
    scale = np.sqrt(2) / np.maximum(spread, 1e-12)
    matrix = np.zeros((*points.shape[:-2], 3, 3))
    matrix[..., 0, 0] = matrix[..., 1, 1] = scale
    matrix[..., :2, 2] = -scale[..., None] * centre[..., 0, :]
    matrix[..., 2, 2] = 1
    return (points - centre) * scale[..., None, None], matrix


def fitted(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Mappings (..., 3, 3) of source to target points (..., n, 2), n of 4 or more: the least singular vector
    of the linear equations in normalised coordinates."""
    (p, t), (q, s) = _normalized(source), _normalized(target)
    one, zero = np.ones(p.shape[:-1]), np.zeros(p.shape[:-1])
    x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
    odd = np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], axis=-1)
    even = np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], axis=-1)
    rows = np.concatenate([odd, even], axis=-2)
    h = np.linalg.svd(np.swapaxes(rows, -1, -2) @ rows, hermitian=True)[2][..., -1, :].reshape(*p.shape[:-2], 3, 3)
    return np.linalg.inv(s) @ h @ t


def _area(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Twice the signed area of triangles."""
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def degenerate(four: np.ndarray, least: float) -> np.ndarray:
    """Which sets (..., 4, 2) hold three points (nearly) on a line."""
    flat = np.zeros(four.shape[:-2], bool)
    for i, j, k in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)):
        flat |= np.abs(_area(four[..., i, :], four[..., j, :], four[..., k, :])) <= least
    return flat


def mapped(h: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (n, 2) under mappings (..., 3, 3), and the denominators."""
    out = np.concatenate([points, np.ones((len(points), 1))], axis=1) @ np.swapaxes(h, -1, -2)
    w = out[..., 2]
    return out[..., :2] / np.where(np.abs(w) < 1e-12, np.nan, w)[..., None], w


def _errors(h: np.ndarray, source: np.ndarray, target: np.ndarray, left: float, right: float) -> np.ndarray:
    """The larger of both directions' distances, as shares of the images' diagonals; infinite where undefined."""
    there, back = mapped(h, source)[0], mapped(np.linalg.inv(h), target)[0]
    worst = np.maximum(np.sqrt(((there - target) ** 2).sum(axis=-1)) / right, np.sqrt(((back - source) ** 2).sum(axis=-1)) / left)
    return np.where(np.isnan(worst), np.inf, worst)


def _basis(p: np.ndarray) -> np.ndarray:
    """Matrices (..., 3, 3) that take the three axes and their sum to four points (..., 4, 2), no three on a line."""
    a, b, c, d = (p[..., k, :] for k in range(4))
    weights = np.stack([_area(b, c, d), _area(c, a, d), _area(a, b, d)], axis=-1)
    return np.concatenate([np.swapaxes(p[..., :3, :], -1, -2), np.ones((*p.shape[:-2], 1, 3))], axis=-2) * weights[..., None, :]


def _adjugate(m: np.ndarray) -> np.ndarray:
    """The inverse (..., 3, 3) times the determinant."""
    (a, b, c), (d, e, f), (g, h, i) = ([m[..., k, j] for j in range(3)] for k in range(3))
    flat = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    return np.stack(flat, axis=-1).reshape(m.shape)


def exact(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Mappings (..., 3, 3), of length one, of four source to four target points (..., 4, 2), no three on a line: what
    fitted() finds from singular vectors, up to sign and rounding, in closed form."""
    middle = lambda x: x.mean(axis=-2, keepdims=True)
    p, q = middle(source), middle(target)
    h = _basis(target - q) @ _adjugate(_basis(source - p))
    h[..., 2] -= (h[..., :2] * p).sum(axis=-1)
    h[..., :2, :] += np.swapaxes(q, -1, -2) * h[..., 2:, :]
    return h / np.sqrt((h * h).sum(axis=(-1, -2), keepdims=True))


def _capped(h: np.ndarray, source: np.ndarray, target: np.ndarray, left: float, right: float, most: float) -> np.ndarray:
    """_errors() up to most, without a mapping's inverse being solved for."""
    squares = []
    for m, points, ends, size in ((h, source, target, right), (_adjugate(h), target, source, left)):
        out = (m.reshape(-1, 3) @ np.concatenate([points, np.ones((len(points), 1))], axis=1).T).reshape(-1, 3, len(points))
        w = out[:, 2]
        squares.append(((out[:, 0] / w - ends[:, 0]) ** 2 + (out[:, 1] / w - ends[:, 1]) ** 2) / size**2)
    return np.sqrt(np.fmin(np.maximum(*squares), most**2))


def _in_reach(at: np.ndarray, source: np.ndarray, target: np.ndarray, left: float, right: float, near: float, slack: float = 1e-7) -> tuple[np.ndarray, bool]:
    """The sets of at that may have the most inliers, or as many at the least errors, and whether these are the same
    matches for all: sets are solved in closed form, whose rounding is another one, so what it cannot tell from the best remains."""
    found = []
    with np.errstate(all="ignore"):
        for a in np.split(at, range(len(at))[:: max(1, 32_768 // len(source))][1:]):
            error = _capped(exact(source[a], target[a]), source, target, left, right, 2 * near)
            sure = error <= near - slack
            found.append((sure, (error <= near + slack).sum(axis=1), np.minimum(error, near).sum(axis=1)))
    sure, most, cost = (np.concatenate(x) for x in zip(*found, strict=True))
    fewest = sure.sum(axis=1)
    top = fewest.max()
    reach = (most > top) | ((most == top) & (cost <= cost[fewest == top].min() + len(source) * slack))
    return at[reach], bool((most[reach] == fewest[reach]).all() and (sure[reach] == sure[reach][0]).all())


def hull_area(points: np.ndarray) -> float:
    """Area of the convex hull."""
    order = [tuple(p) for p in np.unique(points, axis=0).tolist()]

    def half(walk: list) -> list:
        out: list = []
        for p in walk:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(order) + half(order[::-1]) if len(order) > 2 else []
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def _spread(points: np.ndarray, size: tuple[float, float], limits: Limits) -> bool:
    """Whether points cover enough of an image of a size (width, height)."""
    share = points / np.array(size)
    cells = np.unique(np.clip((share * limits.grid).astype(int), 0, limits.grid - 1), axis=0)
    inside = ((share >= limits.interior_margin) & (share <= 1 - limits.interior_margin)).all(axis=1).mean()
    low, high = np.linalg.eigvalsh(np.cov(points.T))
    return bool(
        hull_area(points) / (size[0] * size[1]) >= limits.hull_area and len(cells) >= limits.cells
        and inside >= limits.interior and low / max(high, 1e-12) >= limits.eigen_ratio
    )


def _possible(h: np.ndarray, left: tuple[float, float], right: tuple[float, float], limits: Limits) -> bool:
    """Whether a mapping is well conditioned, keeps the left image before the camera and convex, and neither
    flattens nor scales it beyond the limits. Mirror images are mappings too."""
    h = h / (h[2, 2] if abs(h[2, 2]) > 1e-12 else 1e-12)
    corners = np.array([[0, 0], [left[0] - 1, 0], [left[0] - 1, left[1] - 1], [0, left[1] - 1]], float)
    probes = np.vstack([corners, corners.mean(axis=0)])
    there, w = mapped(h, probes)
    if not np.isfinite(there).all() or not ((w > 0).all() or (w < 0).all()) or np.abs(w).min() < limits.denominator:
        return False
    # Derivative of the mapping at each probe.
    j = (h[None, :2, :2] - there[:, :, None] * h[None, 2:, :2]) / w[:, None, None]
    scales = np.linalg.svd(np.concatenate([h[None, :2, :2], j]), compute_uv=False)
    turns = [_area(there[k], there[(k + 1) % 4], there[(k + 2) % 4]) for k in range(4)]
    area = abs(sum(_area(there[0], there[k], there[k + 1]) for k in (1, 2))) / 2 / (right[0] * right[1])
    return bool(
        np.linalg.cond(h) <= limits.condition and (scales[:, 1] / np.maximum(scales[:, 0], 1e-12)).min() >= limits.singular_ratio
        and scales[:, 1].min() >= limits.scales[0] and scales[:, 0].max() <= limits.scales[1]
        and limits.area_ratios[0] <= area <= limits.area_ratios[1] and (min(turns) > 0 or max(turns) < 0)
    )


def _best(at: np.ndarray, source: np.ndarray, target: np.ndarray, left: float, right: float, near: float) -> tuple[int, np.ndarray | None, int]:
    """Of the mappings of sets at the one with the most inliers, ties by the least errors, their number, and how many
    sets have a mapping."""
    best: tuple = (0, -math.inf, None)
    solved = 0
    for k in range(0, len(at), 256):
        with np.errstate(all="ignore"):
            h = fitted(source[at[k : k + 256]], target[at[k : k + 256]])
            h = h[np.isfinite(h).all(axis=(1, 2)) & (np.abs(np.linalg.det(h)) > 1e-12 * np.linalg.norm(h, axis=(1, 2)) ** 3)]
            solved += len(h)
            if not len(h):
                continue
            error = _errors(h, source, target, left, right)
        inliers = error <= near
        cost = -np.where(inliers, error, near).sum(axis=1)
        top = np.lexsort((-cost, -inliers.sum(axis=1)))[0]
        best = max(best, (int(inliers[top].sum()), float(cost[top]), h[top]), key=lambda b: b[:2])
    return best[0], best[2], solved


def _refitted(h: np.ndarray, source: np.ndarray, target: np.ndarray, left: float, right: float, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """A mapping fitted to its inliers until they no longer change: mapping, errors, inliers, and whether it was fitted at all."""
    error = _errors(h, source, target, left, right)
    inliers, moved = error <= near, False
    for _ in range(20):
        again = fitted(source[inliers], target[inliers])
        if not np.isfinite(again).all() or abs(np.linalg.det(again)) <= 1e-12 * np.linalg.norm(again) ** 3:
            break
        new = _errors(again, source, target, left, right)
        if (new <= near).sum() < inliers.sum():
            break
        settled = ((new <= near) == inliers).all()
        h, error, inliers, moved = again, new, new <= near, True
        if settled:
            break
    return h, error, inliers, moved


def verified(name: str, source: np.ndarray, target: np.ndarray, left: tuple[float, float], right: tuple[float, float], limits: Limits, seed: int, sets: int) -> tuple:
    """A row of RESULT for matches of source to target points (n, 2) in images of two sizes (width, height)."""
    n = len(source)
    out = lambda reason, inliers=None, error=None, h=None: (
        reason, n, 0 if inliers is None else int(inliers.sum()), None if inliers is None else float(inliers.mean()),
        None if error is None else float(np.median(error[inliers])), None if error is None else float(np.percentile(error[inliers], 95)),
        None if h is None else (h / np.linalg.norm(h) * np.sign(h[2, 2] or 1)).ravel().tolist(), None if inliers is None else np.flatnonzero(inliers).tolist(),
    )
    if n < max(4, limits.matches):
        return out(FEW_MATCHES)
    (dl, dr), near = (math.hypot(*left), math.hypot(*right)), limits.reprojection
    at = drawn_sets(name, seed, sets, n)
    at = at[~(degenerate(source[at], 1e-4 * left[0] * left[1]) | degenerate(target[at], 1e-4 * right[0] * right[1]))]
    reach, alike = _in_reach(at, source, target, dl, dr, near) if len(at) else (at, False)
    # Sets with the same inliers are refitted to the same mapping, whichever comes first; should the closed form have solved
    # what cannot be, all sets are judged.
    for sets_of in ([reach[:1]] if alike else []) + [reach, at]:
        count, h, solved = _best(sets_of, source, target, dl, dr, near)
        if solved < len(sets_of) and sets_of is not at:
            continue
        if h is None or count < 4:
            return out(NO_MODEL)
        h, error, inliers, moved = _refitted(h, source, target, dl, dr, near)
        if moved or len(sets_of) == len(reach):
            break
    if inliers.sum() < limits.inliers or inliers.mean() < limits.inlier_ratio:
        return out(FEW_INLIERS, inliers, error, h)
    if np.median(error[inliers]) > limits.median_error or np.percentile(error[inliers], 95) > limits.p95_error:
        return out(INEXACT, inliers, error, h)
    if not (_spread(source[inliers], left, limits) and _spread(target[inliers], right, limits)):
        return out(NO_SPREAD, inliers, error, h)
    return out(CONFIRMED if _possible(h, left, right, limits) else DEGENERATE, inliers, error, h)


def verified_pairs(pairs: DataFrame, limits: Limits | None = None, seed: int = 734_221, sets: int = 1000) -> DataFrame:
    """pairs(pair_id, left_width, left_height, right_width, right_height, matches) -> pair_id with a reason and what
    was found: matches, inliers, their share, median and 95th percentile of their errors (shares of the diagonal,
    the worse of both directions), the mapping (nine numbers by row, of length one) and the inliers' places among
    the matches that are whole. With 1,000 sets and half of the matches wrong, a clean set is missed once in 1e28
    pairs, with three quarters wrong once in 50 pairs.

    matches is an array of (x, y, u, v): a point of the left image and its match in the right one. Null arrays are
    empty; matches with a null or a value that is not finite take no part, and repeated ones count as often as
    they come. Sizes must be positive."""
    limits = limits or Limits()
    whole = F.filter("matches", lambda m: F.forall(F.array(m["x"], m["y"], m["u"], m["v"]), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    flat = F.flatten(F.transform(F.coalesce(whole, F.array().cast(MATCHES)), lambda m: F.array(m["x"], m["y"], m["u"], m["v"])))
    kind = pairs.schema["pair_id"].dataType.simpleString()
    sizes = [F.col(c).cast("double") for c in ("left_width", "left_height", "right_width", "right_height")]
    rows = pairs.select("pair_id", F.coalesce(F.col("pair_id").cast("string"), F.lit("")).alias("name"), F.array(*sizes).alias("sizes"), flat.alias("m"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.string(), pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.list_(pa.float64()), pa.list_(pa.int32())]
        names = [x.split()[0] for x in RESULT.split(", ")]
        for batch in batches:
            out = []
            for name, (lw, lh, rw, rh), m in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if not all(x is not None and x > 0 for x in (lw, lh, rw, rh)):
                    raise ValueError(f"pair {name}: images must have positive sizes")
                points = np.array(m, float).reshape(-1, 4)
                out.append(verified(name, points[:, :2], points[:, 2:], (lw, lh), (rw, rh), limits, seed, sets))
            if out:
                columns = [pa.array(c, f) for c, f in zip(zip(*out, strict=True), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["pair_id", *names])

    # A pair takes milliseconds however few bytes it has, so files' splits are no measure of a task.
    return rows.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"pair_id {kind}, {RESULT}")
