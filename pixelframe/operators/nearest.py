"""The nearest landmark set of each box, inside one group of boxes and sets, in Arrow: both are cut into leaves of a k-d tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Boxes and sets of a leaf; leaves of sets that every box of a leaf is held against at first.
BOX_LEAF, SET_LEAF, FIRST = 64, 32, 4


def _leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """The places of points, in leaves of up to size that lie close: halved along the widest side."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        k = todo.pop()
        if len(k) <= size:
            out.append(k)
            continue
        at = points[k]
        half = len(k) // 2
        order = k[np.argpartition(at[:, np.argmax(np.ptp(at, axis=0))], half)]
        todo += [order[:half], order[half:]]
    return out


def _least(low: np.ndarray, high: np.ndarray, to_low: np.ndarray, to_high: np.ndarray) -> np.ndarray:
    """How ill what is between low and high fits what is between to_low and to_high, at least; the last axis has the four numbers of a fit."""
    gap = np.maximum(np.maximum(to_low - high, low - to_high), 0.0)
    out = np.sqrt(gap[..., 0] ** 2 + gap[..., 1] ** 2) + gap[..., 2] + gap[..., 3]
    return np.where(np.isnan(out), 0.0, out)


def _misfits(box: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """As masks._misfit: box has x, y, w, h, sets x1, y1, x2, y2 in their last axis."""
    x, y, w, h = np.moveaxis(box, -1, 0)
    x1, y1, x2, y2 = np.moveaxis(sets, -1, 0)
    dx, dy = (x1 + x2) * 0.5 - (x + w * 0.5), (y1 + y2) * 0.5 - (y + h * 0.5)
    return np.sqrt(dx * dx + dy * dy) + np.abs(x2 - x1 - w) * 0.25 + np.abs(y2 - y1 - h) * 0.20


def nearest(box: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each box, the row of sets that fits best, the first of equal ones, and how ill it fits. Nothing is left out but what a leaf's bounds rule out."""
    x, y, w, h = box.T
    x1, y1, x2, y2 = sets.T
    b = np.stack([x + w * 0.5, y + h * 0.5, w * 0.25, h * 0.20], 1)
    s = np.stack([(x1 + x2) * 0.5, (y1 + y2) * 0.5, (x2 - x1) * 0.25, (y2 - y1) * 0.20], 1)
    leaves = _leaves(s, SET_LEAF)
    low, high = (np.array([f(s[k], axis=0) for k in leaves]) for f in (np.min, np.max))
    # A row for each leaf; short ones repeat their first place, which changes no minimum.
    members = np.array([np.sort(np.pad(k, (0, SET_LEAF - len(k)), mode="wrap")) for k in leaves])
    slack = 1e-6 + 1e-12 * max(np.abs(b).max(initial=0.0), np.abs(s).max(initial=0.0))
    best, at = np.full(len(b), np.inf), np.full(len(b), len(s))

    def hold(k: np.ndarray, which: np.ndarray) -> None:
        """Hold boxes k against a row each of places of sets."""
        fit = _misfits(box[k][:, None], sets[which])
        fit = np.where(np.isnan(fit), np.inf, fit)
        j = fit.argmin(axis=1)
        n = np.arange(len(k))
        order = np.lexsort((which[n, j], fit[n, j], k))
        first = order[np.r_[True, k[order][1:] != k[order][:-1]]]
        q, f, a = k[first], fit[first, j[first]], which[first, j[first]]
        better = (f < best[q]) | ((f == best[q]) & (a < at[q]))
        best[q[better]], at[q[better]] = f[better], a[better]

    for k in _leaves(b, BOX_LEAF):
        bound = _least(b[k].min(axis=0), b[k].max(axis=0), low, high)
        near = np.argsort(bound, kind="stable")
        first, rest = near[:FIRST], near[FIRST:]
        hold(k, np.tile(np.sort(members[first].ravel()), (len(k), 1)))
        limit = best[k] * (1 + 1e-9) + slack
        rest = rest[bound[rest] <= limit.max()]
        if not len(rest):
            continue
        # The nearest of the others for each box, and then all that its bound still allows.
        own = _least(b[k][:, None], b[k][:, None], low[rest], high[rest])
        close = own.argmin(axis=1)
        some = own[np.arange(len(k)), close] <= limit
        if some.any():
            hold(k[some], members[rest[close[some]]])
        own[np.arange(len(k)), close] = np.inf
        i, j = np.nonzero(own <= (best[k] * (1 + 1e-9) + slack)[:, None])
        for n in range(0, len(i), 16_384):
            hold(k[i[n : n + 16_384]], members[rest[j[n : n + 16_384]]])
    return at, _misfits(box, sets[at])


def of_group(boxes: pa.Table, sets: pa.Table) -> pa.Table:
    """image_id, det_id, set_id, score of one group's boxes."""
    if not len(boxes) or not len(sets):
        none = boxes.slice(0, 0)
        return pa.table({"image_id": none["image_id"], "det_id": none["det_id"], "set_id": sets.slice(0, 0)["set_id"], "score": pa.array([], pa.float64())})
    sets = sets.take(pc.sort_indices(sets, sort_keys=[("set_id", "ascending")], null_placement="at_start"))
    wide = lambda t, cs: np.stack([t[c].to_numpy() for c in cs], 1)
    at, score = nearest(wide(boxes, ("x", "y", "w", "h")), wide(sets, ("x1", "y1", "x2", "y2")))
    return pa.table({"image_id": boxes["image_id"], "det_id": boxes["det_id"], "set_id": sets["set_id"].take(pa.array(at)), "score": pa.array(score, pa.float64())})
