"""Spline fits of many short segments at once.

The steps are those of ``spline.fit_segment``; here every array has a leading axis of segments
with the same number of knots, padded to the longest of them, so a step costs one numpy call for
all. Segments leave the stack once their mask has settled or their fit has failed.
"""

from __future__ import annotations

import numpy as np

from fluxfold.functions.robust import MAD_SCALE_ROUNDED, MEAN_DEVIATION_SCALE, trim_compensation
from fluxfold.functions.spline import SegmentFit, bernstein_powers, interior_knots, solve_normal

#: Numbers in the largest array of one stack.
STACK = 4_000_000
#: The longest segment of a stack has at most so many times the points of the shortest.
PADDING = 1.5


def row_medians(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Median of the known values of each row; NaN where there is none."""
    count = known.sum(axis=1)
    ordered = np.sort(np.where(known, values, np.inf), axis=1)
    at = np.arange(count.size)
    low, high = (np.maximum(count, 1) - 1) // 2, np.maximum(count, 1) // 2
    return np.where(count > 0, (ordered[at, low] + ordered[at, high]) / 2, np.nan)


def row_inliers(residual: np.ndarray, cut: float) -> np.ndarray:
    """``robust.inliers`` of every row; missing values are outliers."""
    known = np.isfinite(residual)
    values = np.where(known, residual, 0.0)
    deviation = np.abs(values - row_medians(values, known)[:, None])
    deviation[~known] = np.inf
    sigma = row_medians(deviation, known) / MAD_SCALE_ROUNDED
    count = np.maximum(known.sum(axis=1), 1)
    spread = MEAN_DEVIATION_SCALE * np.where(known, deviation, 0.0).sum(axis=1) / count
    sigma = np.where(np.abs(sigma) <= 1e-8, spread, sigma)
    mask = known
    open_rows = known.any(axis=1)
    for _ in range(2):
        inside = known & (deviation <= cut * sigma[:, None])
        mask = np.where(open_rows[:, None], inside, mask)
        kept = mask.sum(axis=1)
        open_rows = open_rows & (kept > 0)
        share = np.maximum(kept, 1)
        mean = np.where(mask, values, 0.0).sum(axis=1) / share
        off = np.where(mask, values - mean[:, None], 0.0)
        new = np.sqrt((off * off).sum(axis=1) / share) / trim_compensation(cut)
        sigma = np.where(open_rows, new, sigma)
    return mask


def row_basis(x: np.ndarray, t: np.ndarray, cell: np.ndarray, k: int) -> np.ndarray:
    """``spline.basis`` with own knots ``t`` per row; shape (k + 1, rows, points)."""
    out = np.zeros((k + 1, *x.shape))
    out[0] = 1.0
    for degree in range(1, k + 1):
        carry = np.zeros(x.shape)
        for r in range(degree):
            right = np.take_along_axis(t, cell + r + 1, axis=1)
            left = np.take_along_axis(t, cell + r + 1 - degree, axis=1)
            share = out[r] / (right - left)
            out[r] = carry + (right - x) * share
            carry = (x - left) * share
        out[degree] = carry
    return out


def row_determines(x: np.ndarray, mask: np.ndarray, t: np.ndarray, k: int) -> np.ndarray:
    """``spline.determines`` of the used points of every row."""
    n = t.shape[1] - k - 1
    size = mask.sum(axis=1)
    good = size >= n
    inner = np.arange(1, n - 1)
    if not inner.size:
        return good
    order = np.argsort(~mask, axis=1, kind="stable")
    used = np.take_along_axis(np.where(mask, x, np.inf), order, axis=1)
    after = (used[:, :, None] <= t[:, None, inner]).sum(axis=1)
    pick = inner + np.maximum.accumulate(np.maximum(after - inner, 0), axis=1)
    good &= pick[:, -1] <= size - 2
    at = np.take_along_axis(used, np.minimum(pick, x.shape[1] - 1), axis=1)
    return good & (at < t[:, inner + k + 1]).all(axis=1)


def _solve(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(gram, rhs[..., None])[..., 0]
    except np.linalg.LinAlgError:
        # One singular system fails the whole call.
        return np.array([solve_normal(g, r) for g, r in zip(gram, rhs, strict=True)])


def _pieces(coef: np.ndarray, knots: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """``spline.to_pieces`` of every row: (rows, cells, k + 1)."""
    powers = np.arange(k + 1)
    if not knots.shape[1]:
        return (coef @ bernstein_powers(k) / (high - low)[:, None] ** powers)[:, None, :]
    t = _knot_vector(knots, low, high, k)
    left = np.concatenate([low[:, None], knots], axis=1)
    span = np.concatenate([knots, high[:, None]], axis=1) - left
    nodes = np.linspace(0.0, 1.0, k + 1)
    rows, cells = left.shape
    x = (left[:, :, None] + span[:, :, None] * nodes).reshape(rows, -1)
    cell = np.broadcast_to(np.repeat(np.arange(cells) + k, k + 1), x.shape)
    weights = row_basis(x, t, cell, k)
    values = sum(w * np.take_along_axis(coef, cell - k + a, axis=1) for a, w in enumerate(weights))
    inverse = np.linalg.inv(np.vander(nodes, increasing=True))
    return values.reshape(rows, cells, k + 1) @ inverse.T / span[:, :, None] ** powers


def _knot_vector(knots: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    ends = np.repeat(low[:, None], k + 1, axis=1), np.repeat(high[:, None], k + 1, axis=1)
    return np.concatenate([ends[0], knots, ends[1]], axis=1)


def _fit_stack(
    segments: list[tuple[np.ndarray, np.ndarray]], knots: np.ndarray, k: int, max_iter: int, cut: float
) -> list[SegmentFit]:
    """Fits of segments with more than ``k`` finite values and equally many knots each."""
    rows, n_knots = knots.shape
    sizes = np.array([x.size for x, _ in segments])
    width = int(sizes.max())
    x, y = np.zeros((rows, width)), np.full((rows, width), np.nan)
    for i, (xs, ys) in enumerate(segments):
        x[i, : xs.size], y[i, : xs.size] = xs, ys
        x[i, xs.size :] = xs[-1]
    mask = np.isfinite(y)
    filled = np.where(mask, y, 0.0)
    coef = np.zeros((rows, n_knots + 1 + k))
    low, high = np.full(rows, np.nan), np.full(rows, np.nan)
    matrix = np.zeros((rows, width, n_knots + 1 + k))
    failed: dict[int, SegmentFit] = {}
    live = np.arange(rows)
    for step in range(max_iter):
        if step:
            fitted = (matrix[live] @ coef[live, :, None])[..., 0]
            new = row_inliers(y[live] - fitted, cut)
            moved = (new != mask[live]).any(axis=1)
            live = live[moved]
            mask[live] = new[moved]
        if not live.size:
            break
        used = mask[live]
        enough = used.sum(axis=1) > k
        first, last = used.argmax(axis=1), width - 1 - used[:, ::-1].argmax(axis=1)
        here = np.arange(live.size)
        lows, highs = x[live][here, first], x[live][here, last]
        fits = lows < highs
        if n_knots:
            fits &= (lows < knots[live, 0]) & (knots[live, -1] < highs)
        fits &= row_determines(x[live], used, _knot_vector(knots[live], lows, highs, k), k)
        for i in live[~enough]:
            failed[int(i)] = SegmentFit("insufficient")
        for i in live[enough & ~fits]:
            failed[int(i)] = SegmentFit("bad_knots", n_knots)
        keep = enough & fits
        live, lows, highs = live[keep], lows[keep], highs[keep]
        if not live.size:
            break
        stale = (lows != low[live]) | (highs != high[live])
        low[live], high[live] = lows, highs
        redo = live[stale]
        if redo.size:
            cell = (knots[redo, None, :] <= x[redo, :, None]).sum(axis=2)
            t = _knot_vector(knots[redo], low[redo], high[redo], k)
            part = np.zeros((redo.size, *matrix.shape[1:]))
            for a, w in enumerate(row_basis(x[redo], t, cell + k, k)):
                np.put_along_axis(part, (cell + a)[:, :, None], w[:, :, None], axis=2)
            matrix[redo] = part
        weighted = matrix[live] * mask[live][:, :, None]
        across = weighted.transpose(0, 2, 1)
        coef[live] = _solve(across @ weighted, (across @ filled[live][:, :, None])[..., 0])
    good = np.array([i for i in range(rows) if i not in failed], int)
    out: list[SegmentFit] = [failed.get(i) for i in range(rows)]
    if good.size:
        off = np.where(mask[good], filled[good] - (matrix[good] @ coef[good, :, None])[..., 0], 0.0)
        squares, points = (off * off).sum(axis=1), mask[good].sum(axis=1)
        pieces = _pieces(coef[good], knots[good], low[good], high[good], k)
        for j, i in enumerate(good):
            out[i] = SegmentFit(
                "ok", n_knots, float(low[i]), int(points[j]), float(squares[j]), pieces[j],
                np.flatnonzero(~mask[i, : sizes[i]]),
            )
    return out


def fit_segments(
    segments: list[tuple[np.ndarray, np.ndarray]], spacing: float, k: int, max_iter: int, cut: float
) -> list[SegmentFit]:
    """``spline.fit_segment`` of every (times, values), in stacks of bounded size."""
    out: list[SegmentFit] = [SegmentFit("insufficient")] * len(segments)
    groups: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, (x, y) in enumerate(segments):
        if x.size <= k or np.count_nonzero(np.isfinite(y)) <= k:
            continue
        knots = interior_knots(x[0], x[-1], spacing)
        if knots.size + 1 + k > x.size:
            # More coefficients than points.
            out[i] = SegmentFit("bad_knots", knots.size)
        else:
            groups.setdefault(knots.size, []).append((i, knots))
    for n_knots, members in groups.items():
        # Neighbours in length share a stack, so little of it is padding.
        members.sort(key=lambda member: segments[member[0]][0].size)
        start = 0
        while start < len(members):
            stop = start
            widest = PADDING * segments[members[start][0]][0].size
            while stop < len(members):
                width = segments[members[stop][0]][0].size
                if stop > start and (
                    width > widest or (stop + 1 - start) * width * (n_knots + 1 + k) > STACK
                ):
                    break
                stop += 1
            part = members[start:stop]
            fits = _fit_stack(
                [segments[i] for i, _ in part], np.array([t for _, t in part]).reshape(len(part), n_knots),
                k, max_iter, cut,
            )
            for (i, _), fit in zip(part, fits, strict=True):
                out[i] = fit
            start = stop
    return out
