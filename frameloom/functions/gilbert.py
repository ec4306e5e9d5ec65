"""Space-filling orders of a rectangle: a curve that visits every cell, stepping between neighbours."""

from __future__ import annotations

import numpy as np

#: The share of the curve by which the permutation shifts (golden ratio less one).
GOLDEN = (5**0.5 - 1) / 2


def _sign(v: int) -> int:
    return (v > 0) - (v < 0)


def gilbert_curve(w: int, h: int) -> np.ndarray:
    """(w*h, 2) cells in curve order, from (0, 0), by the public generalised Hilbert rule for rectangles (fixed: the order
    of cells must be this one). A stack of sub-rectangles stands in for recursion.

    Each rectangle is given by its corner, its main axis and its side axis. A long one is halved along
    the main axis; any other is cut in three, so that the path enters and leaves at the right corners.
    """
    if w <= 0 or h <= 0:
        return np.zeros((0, 2), np.int32)
    out = np.empty((w * h, 2), np.int32)
    n = 0
    todo = [(0, 0, w, 0, 0, h) if w >= h else (0, 0, 0, h, w, 0)]
    while todo:
        x, y, ax, ay, bx, by = todo.pop()
        long, short = abs(ax + ay), abs(bx + by)
        step, side = (_sign(ax), _sign(ay)), (_sign(bx), _sign(by))
        if short == 1 or long == 1:
            count, (dx, dy) = (long, step) if short == 1 else (short, side)
            at = np.arange(count)
            out[n : n + count, 0], out[n : n + count, 1] = x + dx * at, y + dy * at
            n += count
            continue
        cx, cy, ex, ey = ax // 2, ay // 2, bx // 2, by // 2
        if 2 * long > 3 * short:
            if abs(cx + cy) % 2 and long > 2:
                cx, cy = cx + step[0], cy + step[1]
            parts = [(x, y, cx, cy, bx, by), (x + cx, y + cy, ax - cx, ay - cy, bx, by)]
        else:
            if abs(ex + ey) % 2 and short > 2:
                ex, ey = ex + side[0], ey + side[1]
            parts = [
                (x, y, ex, ey, cx, cy), (x + ex, y + ey, ax, ay, bx - ex, by - ey),
                (x + ax - step[0] + ex - side[0], y + ay - step[1] + ey - side[1], -ex, -ey, cx - ax, cy - ay),
            ]
        todo.extend(reversed(parts))
    return out


def shift(n: int) -> int:
    return int(GOLDEN * n + 0.5)
