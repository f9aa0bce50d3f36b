"""Pixel kernels on one slice: blur, edges, outlines, polygons and splines, in NumPy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


def box_blur(img: np.ndarray) -> np.ndarray:
    """3x3 mean with mirrored borders (the edge pixel is not repeated), rounded to bytes."""
    p = np.pad(img.astype(np.int64), 1, mode="reflect") if min(img.shape) > 1 else np.pad(img.astype(np.int64), 1, mode="edge")
    h, w = img.shape
    total = sum(p[i : i + h, j : j + w] for i in range(3) for j in range(3))
    return np.rint(total / 9).astype(np.uint8)


def edges(img: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """Canny edges: 3x3 Sobel, L1 magnitude, non-maximum suppression, hysteresis."""
    p = np.pad(img.astype(np.int64), 1, mode="edge")
    h, w = img.shape
    at = lambda i, j: p[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    gx = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    gy = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    mag = np.abs(gx) + np.abs(gy)
    m = np.pad(mag, 1)
    near = lambda i, j: m[1 + i : 1 + i + h, 1 + j : 1 + j + w]
    flat = np.abs(gy) <= np.abs(gx) * np.tan(np.pi / 8)
    steep = np.abs(gy) >= np.abs(gx) * np.tan(3 * np.pi / 8)
    down = gx * gy >= 0
    best = np.where(
        flat, (mag > near(0, -1)) & (mag >= near(0, 1)),
        np.where(steep, (mag > near(-1, 0)) & (mag >= near(1, 0)), np.where(down, (mag > near(-1, -1)) & (mag > near(1, 1)), (mag > near(-1, 1)) & (mag > near(1, -1)))),
    )
    weak = best & (mag > low)
    lines = runs(weak)
    number = connected(lines, diagonal=True)
    strong = np.concatenate([[0], np.cumsum((best & (mag > high)).ravel())])
    held = strong[lines.row * w + lines.end] > strong[lines.row * w + lines.start]
    keep = np.zeros(number.max(initial=-1) + 1, bool)
    keep[number[held]] = True
    return painted(lines, keep[number], (h, w)).astype(np.uint8) * 255


class Runs(NamedTuple):
    """Stretches of true pixels in scan order: columns from ``start`` up to ``end`` of a row."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    width: int

    def holding(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Which run each pixel lies in."""
        return np.searchsorted(self.row * self.width + self.start, np.asarray(y) * self.width + np.asarray(x), side="right") - 1


def runs(mask: np.ndarray) -> Runs:
    h, w = mask.shape
    wide = np.zeros((h, w + 1), bool)
    wide[:, :w] = mask
    # A row ends with a false pixel, so no run crosses into the next one.
    change = np.flatnonzero(np.diff(wide.ravel(), prepend=False))
    row, start = np.divmod(change[::2], w + 1)
    return Runs(row, start, change[1::2] - row * (w + 1), w)


def connected(lines: Runs, diagonal: bool) -> np.ndarray:
    """Of each run the number of its component, from 0, in scan order of their first pixels.

    Runs touch those of the row below that begin before they end; both ends of
    that range are found by bisection. Each component then takes its least run's
    place: places sink to the least neighbour's, and pointers are halved, until
    nothing changes.
    """
    n, reach, step = len(lines.row), int(diagonal), lines.width + 2
    first = np.searchsorted(lines.row * step + lines.end, (lines.row + 1) * step + lines.start + 1 - reach)
    after = np.searchsorted(lines.row * step + lines.start, (lines.row + 1) * step + lines.end + reach)
    count = np.maximum(after - first, 0)
    a = np.repeat(np.arange(n), count)
    b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    place = np.arange(n)
    while len(a):
        low, high = np.minimum(place[a], place[b]), np.maximum(place[a], place[b])
        open_ = low < high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(place, high[open_], low[open_])
        while (place[place] != place).any():
            place = place[place]
    return np.unique(place, return_inverse=True)[1].reshape(-1)


def painted(lines: Runs, keep: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """A mask of the runs that are kept."""
    marks = np.zeros(shape[0] * shape[1] + 1, np.int8)
    np.add.at(marks, lines.row[keep] * lines.width + lines.start[keep], 1)
    np.add.at(marks, lines.row[keep] * lines.width + lines.end[keep], -1)
    return np.cumsum(marks[:-1], dtype=np.int8).reshape(shape) > 0


#: Eight neighbours in clockwise order, (row, column), from the left one.
RING = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def _turns() -> bytes:
    """By direction and neighbours (a bit each): the first neighbour clockwise after that direction; 8 for none."""
    return bytes(next((d % 8 for d in range(back + 1, back + 9) if near >> d % 8 & 1), 8) for back in range(8) for near in range(256))


TURNS = _turns()


class Borders:
    """Borders of a mask that has one pixel of nothing around it, followed by a table: only their pixels are touched."""

    def __init__(self, m: np.ndarray):
        h, w = m.shape
        near = np.zeros((h, w), np.uint8)
        for k, (dy, dx) in enumerate(RING):
            near[1:-1, 1:-1] |= m[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx].astype(np.uint8) << np.uint8(k)
        self.near, self.width, self.step = near.tobytes(), w, [dy * w + dx for dy, dx in RING]

    def follow(self, y: int, x: int, back: int) -> np.ndarray:
        """The border through (y, x), clockwise, from the neighbour that ``back`` names; (x, y) corners where the direction changes."""
        near, step, at = self.near, self.step, y * self.width + x
        first, path, took = at, [], []
        d = TURNS[back << 8 | near[at]]
        if d == 8:
            return np.array([(x - 1, y - 1)])
        begin = d
        while True:
            path.append(at)
            took.append(d)
            at += step[d]
            d = TURNS[(d + 4 & 7) << 8 | near[at]]
            if at == first and d == begin:
                break
        path, took = np.array(path), np.array(took)
        if len(path) > 2:
            path = path[took != np.roll(took, 1)]
        rows, cols = np.divmod(path, self.width)
        return np.stack([cols, rows], axis=1) - 1


def outline_tree(mask: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Outlines as (x, y) corners, and the place of each one's parent (-1 for none).

    Every 8-connected component has an outer outline, and one around each of its
    holes, whose points are the component's own. All come in scan order of their
    first pixel. A hole's parent is its component, an outer outline's the hole
    that it lies in. Components are of runs, so their cost is that of the runs,
    and following touches border pixels alone.
    """
    m = np.pad(mask > 0, 1)
    full, bare = runs(m), runs(~m)
    if not len(full.row):
        return [], []
    inside, outside = connected(full, diagonal=True), connected(bare, diagonal=False)
    first = lambda number: np.unique(number, return_index=True)[1]
    a, b = first(inside), first(outside)[1:]  # what lies around everything comes first
    around = outside[bare.holding(full.row[a], full.start[a] - 1)]
    owner = inside[full.holding(bare.row[b], bare.start[b] - 1)]
    begins = [(y, x, 0, k, o) for k, (y, x, o) in enumerate(zip(full.row[a].tolist(), full.start[a].tolist(), around.tolist(), strict=True))]
    begins += [(y, x - 1, 4, k, o) for k, (y, x, o) in enumerate(zip(bare.row[b].tolist(), bare.start[b].tolist(), owner.tolist(), strict=True), 1)]
    begins.sort()
    place = {(back, k): i for i, (_, _, back, k, _) in enumerate(begins)}
    follow = Borders(m).follow
    found = [follow(y, x, back) for y, x, back, _, _ in begins]
    return found, [place[0, o] if back else place.get((4, o), -1) for _, _, back, _, o in begins]


def outlines(mask: np.ndarray) -> list[np.ndarray]:
    """Outer outlines alone, in scan order."""
    m = np.pad(mask > 0, 1)
    lines = runs(m)
    begin = np.unique(connected(lines, diagonal=True), return_index=True)[1]
    follow = Borders(m).follow
    return [follow(y, x, 0) for y, x in zip(lines.row[begin].tolist(), lines.start[begin].tolist(), strict=True)]


def mask_edges(mask: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Edges of a blurred byte mask where it has any pixels, with the row and column of that part; all else has none."""
    rows, cols = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(rows):
        return np.zeros((1, 1), np.uint8), 0, 0
    top, left = max(0, int(rows[0]) - 4), max(0, int(cols[0]) - 4)
    return edges(box_blur(mask[top : rows[-1] + 5, left : cols[-1] + 5] * 255 % 256)), top, left


def shape(mask: np.ndarray) -> tuple[int, tuple[int, int, int, int], tuple[int, int, int, int]] | None:
    """Of a mask's edges: how many outlines, the extents (top, bottom, left, right) of the largest, and the rectangle around it simplified."""
    drawn, dy, dx = mask_edges(mask)
    found, _ = outline_tree(drawn)
    if not found:
        return None
    top = found[biggest(found)] + (dx, dy)
    x, y = top[:, 0], top[:, 1]
    return len(found), (int(y.min()), int(y.max()), int(x.min()), int(x.max())), rect(simplified(top))


def window_sums(spots: np.ndarray, rows: np.ndarray, cols: np.ndarray, height: int | np.ndarray, width: int | np.ndarray | None = None) -> np.ndarray:
    """How many true pixels lie in each window (of ``height`` by ``width``, or square), by a table of running sums; windows are cut to the slice as array slices are."""
    width = height if width is None else width
    h, w = spots.shape
    table = np.zeros((h + 1, w + 1), np.int64)
    table[1:, 1:] = spots.cumsum(axis=0).cumsum(axis=1)
    cut = lambda v, n: np.clip(np.where(v < 0, v + n, v), 0, n)
    a, b, c, d = cut(rows, h), cut(rows + height, h), cut(cols, w), cut(cols + width, w)
    b, d = np.maximum(a, b), np.maximum(c, d)
    return table[b, d] - table[a, d] - table[b, c] + table[a, c]


def area(points: np.ndarray) -> float:
    """Enclosed area by the shoelace formula."""
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return float(abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2)


def biggest(found: list[np.ndarray]) -> int:
    """Index of the outline of the largest area, the first of equals."""
    return int(np.argmax([area(p) for p in found]))


def _split(points: np.ndarray, first: int, last: int, eps: float) -> list[int]:
    """Corners from ``first`` up to ``last`` (which may run past the end of the polygon), without the last: a stretch is cut at its farthest point until none is farther from its chord than ``eps``."""
    kept, todo, n = [], [(first, last)], len(points)
    while todo:
        a, b = todo.pop()
        p, chord = points[a % n], points[b % n] - points[a % n]
        inner = points[np.arange(a + 1, b) % n] - p
        off = np.abs(inner[:, 1] * chord[0] - inner[:, 0] * chord[1])
        if not len(off) or float(off.max()) ** 2 <= eps**2 * float(chord @ chord):
            kept.append(a % n)
        else:
            k = a + 1 + int(off.argmax())
            todo += [(k, b), (a, k)]
    return kept


def simplified(points: np.ndarray, eps: float = 3.0) -> np.ndarray:
    """A closed polygon with fewer corners, none of those left out farther than ``eps`` from a side.

    It is split at two corners far apart, found by going three times from a corner
    to the one farthest from it, starting at the first. Both halves are cut at
    their farthest points (Douglas and Peucker). At last every corner that lies
    near the slanted line between its neighbours (half of ``eps`` squared) and
    does not turn back is left out. If all points are within ``eps`` of the corner
    that was reached, it alone stays.
    """
    points = np.asarray(points, np.int64)
    n = len(points)
    if n < 2:
        return points
    at = far = 0
    for _ in range(3):
        at = (at + far) % n
        away = ((np.roll(points, -at, axis=0) - points[at]) ** 2).sum(axis=1)
        far = int(away.argmax()) if away.max() > 0 else far
    if away.max() <= eps**2:
        return points[[at]]
    kept = [points[i] for i in [*_split(points, at, at + far, eps), *_split(points, at + far, at + n, eps)]]
    return _straightened(kept, eps)


def _straightened(corners: list[np.ndarray], eps: float) -> np.ndarray:
    """``corners`` without those that are nearly on the way from the corner before to the one after; after one is left out, the next stays.

    What stays is moved up in place, so the last corner is judged against what
    stands first by then. At least two are left.
    """
    corners, n = np.array(corners), len(corners)
    left, to, i = n, 0, 0
    before, corner = corners[-1].copy(), corners[0].copy()
    while i < n and left > 2:
        after = corners[(i + 1) % n].copy()
        way, into, on = after - before, corner - before, after - corner
        off = float(abs(into[0] * way[1] - into[1] * way[0]))
        straight = off**2 <= 0.5 * eps**2 * float(way @ way) and way[0] and way[1] and into @ on >= 0
        before = after if straight else corner
        corners[to % n] = before
        to += 1
        corner = corners[(i + 2) % n].copy() if straight else after
        left -= bool(straight)
        i += 2 if straight else 1
    return corners[:left]


def rect(points: np.ndarray) -> tuple[int, int, int, int]:
    """x, y, width, height of the upright rectangle around points."""
    x, y = points[:, 0], points[:, 1]
    return int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)


def _coefficients(c: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients along the first axis, mirrored at both ends."""
    z, n = np.sqrt(3) - 2, len(c)
    if n == 1:
        return c.astype(float)
    c = c.astype(float) * 6
    k = np.arange(1, 40)
    powers, k = z**k, k % (2 * n - 2)
    mirrored = c[np.where(k < n, k, 2 * n - 2 - k)]
    c[0] = c[0] + (powers.reshape(-1, *[1] * (c.ndim - 1)) * mirrored).sum(axis=0)
    for i in range(1, n):
        c[i] += z * c[i - 1]
    c[-1] = z / (z * z - 1) * (c[-1] + z * c[-2])
    for i in range(n - 2, -1, -1):
        c[i] = z * (c[i + 1] - c[i])
    return c


def _sampled(c: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, base = len(c), np.floor(at).astype(int)
    t = at - base
    weights = ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)
    out = 0
    for k, wt in enumerate(weights):
        i = np.abs(base + k - 1)
        i = np.where(i > n - 1, 2 * (n - 1) - i, i).clip(0, n - 1)
        out = out + wt.reshape(-1, *[1] * (c.ndim - 1)) * c[i]
    return out


def nearest_resampled(img: np.ndarray, spacing: tuple[float, float], target: float, fill: float = 0.0) -> np.ndarray:
    """The nearest pixel of each place; places outside of the input get ``fill``."""
    at = [np.floor(np.arange(int(np.rint(n * (s / target)))) * target / s + 0.5).astype(int) for n, s in zip(img.shape, spacing, strict=True)]
    out = img[np.ix_(*(a.clip(0, n - 1) for a, n in zip(at, img.shape, strict=True)))].astype(float)
    out[at[0] >= img.shape[0], :] = fill
    out[:, at[1] >= img.shape[1]] = fill
    return out


def spline_resampled(img: np.ndarray, spacing: tuple[float, float], target: float, fill: float = 0.0) -> np.ndarray:
    """Cubic B-spline interpolation of one slice; places outside of the input get ``fill``."""
    out, outside = img.astype(float), []
    for axis in (0, 1):
        n = out.shape[axis]
        size = int(np.rint(n * (spacing[axis] / target)))
        at = np.arange(size) * target / spacing[axis]
        moved = _sampled(_coefficients(np.moveaxis(out, axis, 0)), at.clip(0, n - 1))
        out = np.moveaxis(moved, 0, axis)
        outside.append(at > n - 0.5)
    out[outside[0], :] = fill
    out[:, outside[1]] = fill
    return out
