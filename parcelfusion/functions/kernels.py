"""Arrow kernels for geometry that compares every edge of one shape with every edge of another.

As nested lambdas these run interpreted, with every shared term computed again for each pair of edges: 180,000
pairs of parcels took over two minutes so and take about a second here. A kernel lays all pairs of edges
of a batch end to end and works on them as numpy arrays, in runs of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Pairs of edges worked on at once; points of a padded block, which the processor's cache holds.
RUN, BLOCK = 1 << 16, 1 << 16


class Lists:
    """A column of lists of numbers laid end to end: all values, and how many each row has (0 for null rows). Rows are taken by slice or by mask."""

    def __init__(self, values: np.ndarray, n: np.ndarray):
        self.values, self.n = values, n

    @classmethod
    def of(cls, column: pa.Array | list[np.ndarray]) -> Lists:
        if isinstance(column, list):
            return cls(np.concatenate(column) if column else np.zeros(0), np.fromiter(map(len, column), np.int64, len(column)))
        return cls(column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))

    def __len__(self) -> int:
        return len(self.n)

    def __getitem__(self, rows: slice | np.ndarray) -> Lists:
        if isinstance(rows, slice):
            low, high = self.n[: rows.start].sum(), self.n[: rows.stop].sum()
            return Lists(self.values[low:high], self.n[rows])
        return self if rows.all() else Lists(self.values[np.repeat(rows, self.n)], self.n[rows])


class Rings:
    """Rings of a batch laid end to end: vertices, the vertex after each, and where each ring begins."""

    def __init__(self, flat: Lists | list[np.ndarray]):
        flat = flat if isinstance(flat, Lists) else Lists.of(flat)
        self.n = flat.n // 2
        self.begin = np.cumsum(self.n) - self.n
        self.at = flat.values.reshape(-1, 2)
        after = np.arange(1, len(self.at) + 1)
        ends = (self.begin + self.n - 1)[self.n > 0]
        after[ends] = self.begin[self.n > 0]
        self.to = self.at[after] if len(self.at) else self.at
        self.of = np.repeat(np.arange(len(flat)), self.n)

    def turned(self) -> np.ndarray:
        """1 for counter-clockwise rings, else -1."""
        first = self.at[np.minimum(self.begin, max(len(self.at) - 1, 0))] if len(self.at) else np.zeros((len(self.n), 2))
        p, q = self.at - first[self.of], self.to - first[self.of]
        return np.where(np.bincount(self.of, p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], len(self.n)) < 0, -1.0, 1.0)


class Shapes(Rings):
    """Shapes of a batch as edges laid end to end: closed for polygons (kind 2), open for lines (1), of no length for points (0).

    ``sizes``: vertices of each part of each shape. ``corner``, ``corner_of``: a vertex of each part, and its shape.
    """

    def __init__(self, flat: Lists, sizes: Lists, kind: np.ndarray):
        part = sizes.values.astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes.n)
        place = np.cumsum(part) - part
        row, place, part = row[part > 0], place[part > 0], part[part > 0]
        vertex = flat.values.reshape(-1, 2)
        self.kind = kind
        closed = kind[row] == 2
        n = np.where(closed, part, np.maximum(part - 1, 1))
        of = np.repeat(np.arange(len(part)), n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        self.at = vertex[place[of] + k]
        self.to = vertex[place[of] + np.where(closed[of], (k + 1) % part[of], np.minimum(k + 1, part[of] - 1))]
        self.of = row[of]
        self.n = np.bincount(self.of, minlength=len(kind))
        self.begin = np.cumsum(self.n) - self.n
        self.corner, self.corner_of = vertex[place], row


def crossed(n: np.ndarray, m: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (row, i, j) with i of the row's ``n`` items from ``first`` and j of its ``m`` items from ``second``."""
    size = n * m
    row = np.repeat(np.arange(len(n)), size)
    k = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    return row, first[row] + k // m[row], second[row] + k % m[row]


def overlap(a: Rings, b: Rings) -> np.ndarray:
    """Shared area of each row's two rings.

    Between the x's that two edges share, the area under the lower one is added if both run the same way and
    taken off if not.
    """
    row, i, j = crossed(a.n, b.n, a.begin, b.begin)
    origin = a.at[np.minimum(a.begin, max(len(a.at) - 1, 0))][row]
    p, q, r, s = a.at[i] - origin, a.to[i] - origin, b.at[j] - origin, b.to[j] - origin
    low = np.maximum(np.minimum(p[:, 0], q[:, 0]), np.minimum(r[:, 0], s[:, 0]))
    high = np.minimum(np.maximum(p[:, 0], q[:, 0]), np.maximum(r[:, 0], s[:, 0]))
    on = high > low
    row, p, q, r, s, low, high = row[on], p[on], q[on], r[on], s[on], low[on], high[on]
    y = lambda u, v, x: u[:, 1] + (v[:, 1] - u[:, 1]) * ((x - u[:, 0]) / (v[:, 0] - u[:, 0]))
    e0, e1, f0, f1 = y(p, q, low), y(p, q, high), y(r, s, low), y(r, s, high)
    d0, d1 = e0 - f0, e1 - f1
    apart = np.abs(d0) + np.abs(d1)
    gap = np.where(d0 * d1 >= 0, apart, (d0 * d0 + d1 * d1) / np.where(apart > 0, apart, 1.0))
    sign = np.where((q[:, 0] < p[:, 0]) == (s[:, 0] < r[:, 0]), 1.0, -1.0)
    under = sign * (high - low) * ((e0 + e1 + f0 + f1) - gap) / 4
    whole = np.bincount(row, under, len(a.n)) * a.turned() * b.turned()
    inside = (getattr(a, "kind", 2) == 2) & (getattr(b, "kind", 2) == 2)  # lines and points have none
    return np.where(inside, np.maximum(0.0, whole), 0.0)


def crossing(rings: Rings) -> np.ndarray:
    """Whether two edges of each ring that aren't neighbours meet (touching counts)."""
    row, i, j = crossed(rings.n, rings.n, rings.begin, rings.begin)
    k, m = i - rings.begin[row], j - rings.begin[row]
    apart = (m > k + 1) & ((k > 0) | (m < rings.n[row] - 1))
    row, i, j = row[apart], i[apart], j[apart]
    p, q, r, s = rings.at[i], rings.to[i], rings.at[j], rings.to[j]
    turn = lambda u, v, w: (v[:, 0] - u[:, 0]) * (w[:, 1] - u[:, 1]) - (v[:, 1] - u[:, 1]) * (w[:, 0] - u[:, 0])
    near = (np.minimum(p, q) <= np.maximum(r, s)).all(axis=1) & (np.minimum(r, s) <= np.maximum(p, q)).all(axis=1)
    row, p, q, r, s = row[near], p[near], q[near], r[near], s[near]
    hit = (turn(r, s, p) * turn(r, s, q) <= 0) & (turn(p, q, r) * turn(p, q, s) <= 0)
    return np.bincount(row, hit, len(rings.n)) > 0


def holds(shapes: Shapes, points: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each point is inside the polygon of its row ``of``, by the parity of edges crossed to its right."""
    _, i, j = crossed(np.ones(len(points), np.int64), shapes.n[of], np.arange(len(points)), shapes.begin[of])
    p, u, v = points[i], shapes.at[j], shapes.to[j]
    spans = (u[:, 1] > p[:, 1]) != (v[:, 1] > p[:, 1])
    rise = np.where(spans, v[:, 1] - u[:, 1], 1.0)
    hits = spans & (p[:, 0] < u[:, 0] + (p[:, 1] - u[:, 1]) * (v[:, 0] - u[:, 0]) / rise)
    return (np.bincount(i, hits, len(points)).astype(np.int64) % 2 == 1) & (shapes.kind[of] == 2)


def meet(a: Shapes, b: Shapes) -> np.ndarray:
    """1 where the shapes of a row share a point: edges meet (touching counts), or a corner of a part is inside the other shape."""
    row, i, j = crossed(a.n, b.n, a.begin, b.begin)
    p, q, r, s = a.at[i], a.to[i], b.at[j], b.to[j]
    turn = lambda u, v, w: (v[:, 0] - u[:, 0]) * (w[:, 1] - u[:, 1]) - (v[:, 1] - u[:, 1]) * (w[:, 0] - u[:, 0])
    on = (np.minimum(p, q) <= np.maximum(r, s)).all(axis=1) & (np.minimum(r, s) <= np.maximum(p, q)).all(axis=1)
    row, p, q, r, s = row[on], p[on], q[on], r[on], s[on]
    hit = (turn(r, s, p) * turn(r, s, q) <= 0) & (turn(p, q, r) * turn(p, q, s) <= 0)
    out = np.bincount(row, hit, len(a.n)) > 0
    for one, other in ((a, b), (b, a)):
        inside = holds(other, one.corner, one.corner_of)
        out |= np.bincount(one.corner_of, inside, len(a.n)) > 0
    return out.astype(np.float64)


def apart(a: Shapes, b: Shapes) -> np.ndarray:
    """Least distance of each row's two shapes; 0 where they share a point."""
    out = np.full(len(a.n), np.inf)
    for one, other in ((a, b), (b, a)):
        for ends in (one.at, one.to):
            np.minimum.at(out, one.of, nearest(ends, one.of, other))
    return np.where(meet(a, b) > 0, 0.0, out)


def nearest(points: np.ndarray, of: np.ndarray, rings: Rings) -> np.ndarray:
    """Least distance of each point from the boundary of the ring of its row ``of``."""
    _, i, j = crossed(np.ones(len(points), np.int64), rings.n[of], np.arange(len(points)), rings.begin[of])
    u, ahead, w = rings.at[j], rings.to[j] - rings.at[j], points[i]
    square = (ahead * ahead).sum(axis=1)
    t = np.clip(((w - u) * ahead).sum(axis=1) / np.where(square > 0, square, 1.0), 0.0, 1.0)
    gap = w - (u + t[:, None] * ahead)
    d = np.sqrt((gap * gap).sum(axis=1))
    return np.minimum.reduceat(d, np.cumsum(rings.n[of]) - rings.n[of]) if len(d) else np.zeros(0)


def from_boundary(x: np.ndarray, y: np.ndarray, points: np.ndarray, rings: Rings, rows: slice) -> np.ndarray:
    """Distances of runs of ``points`` from the boundary of the ring of each of the ``rows``, edge after edge against a whole run.

    A table with a row for each run, filled up to the longest with inf, which sorts last.
    """
    width = int(points.max(initial=0))
    full = np.arange(width) < points[:, None]
    if full.all():
        x, y = x.reshape(full.shape), y.reshape(full.shape)
    else:
        tables = np.zeros((2, *full.shape))
        tables[0][full], tables[1][full] = x, y
        x, y = tables
    best, room = np.full(x.shape, np.inf), np.empty((4, *x.shape))
    n, begin = rings.n[rows], rings.begin[rows]
    for k in range(int(n.max(initial=0))):
        has = n > k
        on = slice(None) if has.all() else np.flatnonzero(has)
        at = begin[on] + k
        start, ahead = rings.at[at], rings.to[at] - rings.at[at]
        square = (ahead * ahead).sum(axis=1)
        (ax, ay), (dx, dy), inverse = start.T[:, :, None], ahead.T[:, :, None], (1.0 / np.where(square > 0, square, 1.0))[:, None]
        px, py, t, u = room[:, : len(at)]
        np.subtract(x[on], ax, out=px)
        np.subtract(y[on], ay, out=py)
        np.multiply(px, dx, out=t)
        t += np.multiply(py, dy, out=u)
        t *= inverse
        np.minimum(np.maximum(t, 0.0, out=t), 1.0, out=t)
        px -= np.multiply(t, dx, out=u)
        py -= np.multiply(t, dy, out=u)
        px *= px
        py *= py
        px += py
        best[on] = np.minimum(best[on], px, out=t)
    best[~full] = np.inf
    return np.sqrt(best, out=best)


def blocks(sizes: np.ndarray, most: int = BLOCK) -> Iterator[slice]:
    """Runs of rows that, filled up to the longest, hold ``most`` items and waste no more than half; or a single row."""
    first, width, least = 0, 0, 0
    for k, n in enumerate(sizes.tolist()):
        wide, low = max(width, n), min(least, n) if k > first else n
        if k > first and (wide * (k + 1 - first) > most or wide > 2 * low + 32):
            yield slice(first, k)
            first, wide, low = k, n, n
        width, least = wide, low
    if len(sizes):
        yield slice(first, len(sizes))


def sampled(rings: Rings, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, points of each row) sampled along each boundary from its first vertex: every ``step``, closer on short ones, at least 20."""
    ahead = rings.to - rings.at
    length = np.sqrt((ahead * ahead).sum(axis=1))
    whole = np.bincount(rings.of, length, len(rings.n))
    gap = np.where(whole > 0, np.maximum(0.2, np.minimum(step, whole / 20.0)), 1.0)
    n = np.where(whole > 0, np.maximum(20, (whole / gap).astype(np.int64)), 0)
    # Lengths inside the ring, so that a long batch costs no digits; then how many samples stand before each edge's end.
    inside = within_rows(length, rings)
    every = gap[rings.of]
    before = np.floor(inside / every).astype(np.int64)
    before += before * every < inside
    before -= (before > 0) & ((before - 1) * every >= inside)
    before = np.minimum(before, n[rings.of])
    ends = (rings.begin + rings.n - 1)[rings.n > 0]
    before[ends] = n[rings.n > 0]
    held = before.copy()
    held[1:] -= before[:-1]
    starts = rings.begin[rings.n > 0]
    held[starts] = before[starts]
    along = lambda values: np.repeat(values, held)
    part = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * np.repeat(gap, n)
    part -= along(inside - length)
    part /= along(np.where(length > 0, length, 1.0))
    x, y = (along(rings.at[:, c]) + along(ahead[:, c]) * part for c in (0, 1))
    return x, y, n


def within_rows(values: np.ndarray, rings: Rings) -> np.ndarray:
    """Running sums of ``values`` inside each ring."""
    out = values.copy()
    for e in range(1, int(rings.n.max()) if len(rings.n) else 0):
        at = (rings.begin + e)[rings.n > e]
        out[at] += out[at - 1]
    return out


def hausdorff(a: Rings, b: Rings) -> np.ndarray:
    """Vertex-sampled Hausdorff distance of each row's two boundaries."""
    one, two = np.zeros(len(a.n)), np.zeros(len(a.n))
    np.maximum.at(one, a.of, nearest(a.at, a.of, b))
    np.maximum.at(two, b.of, nearest(b.at, b.of, a))
    return np.maximum(one, two)


def within(rings: Rings, points: np.ndarray, margin: float) -> np.ndarray:
    """Whether each row's point is inside its ring, or nearer than ``margin`` to it."""
    p, u, v = points[rings.of], rings.at, rings.to
    spans = (u[:, 1] > p[:, 1]) != (v[:, 1] > p[:, 1])
    rise = np.where(spans, v[:, 1] - u[:, 1], 1.0)
    hits = spans & (p[:, 0] < u[:, 0] + (p[:, 1] - u[:, 1]) * (v[:, 0] - u[:, 0]) / rise)
    inside = np.bincount(rings.of, hits, len(rings.n)).astype(np.int64) % 2 == 1
    return inside | (nearest(points, np.arange(len(points)), rings) < margin)


def scanned(rings: Shapes, pitch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shape, row, x0, x1): the intervals that rows of pixels, at multiples of ``pitch`` in y, run inside polygons."""
    low, high = np.minimum(rings.at[:, 1], rings.to[:, 1]), np.maximum(rings.at[:, 1], rings.to[:, 1])
    first = np.floor(low / pitch).astype(np.int64)
    n = np.ceil(high / pitch).astype(np.int64) - first + 1
    e = np.repeat(np.arange(len(n)), n)
    row = first[e] + np.arange(len(e)) - np.repeat(np.cumsum(n) - n, n)
    on = (low[e] <= row * pitch) & (row * pitch < high[e])
    e, row = e[on], row[on]
    p, q = rings.at[e], rings.to[e]
    x, of = p[:, 0] + (row * pitch - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1]), rings.of[e]
    order = np.lexsort((x, row, of))
    x, row, of = x[order], row[order], of[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), (np.diff(of) != 0) | (np.diff(row) != 0)]))
    size = np.diff(np.append(starts, len(x)))
    k = np.arange(len(x)) - np.repeat(starts, size)
    even = np.flatnonzero((k % 2 == 0) & (k + 1 < np.repeat(size, size)))
    return of[even], row[even], x[even], x[even + 1]


def in_runs(work: Callable[..., np.ndarray], sizes: np.ndarray, *columns: Lists | np.ndarray, empty: np.ndarray | None = None, run: int = RUN) -> np.ndarray:
    """``work`` over consecutive rows, some ``run`` items of ``sizes`` at a time."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // run)) + 1
    bounds = [0, *cuts.tolist(), len(sizes)]
    return np.concatenate([work(*[c[i:j] for c in columns]) for i, j in zip(bounds, bounds[1:], strict=False) if j > i] or [np.zeros(0) if empty is None else empty])


def numbers(column: pa.Array) -> np.ndarray:
    """A column of numbers as doubles, nulls as NaN."""
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def found(values: np.ndarray, known: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The values, null where not known."""
    return pa.array(values, kind, mask=~known)


def pairwise(work: Callable[[Rings, Rings], np.ndarray]) -> Callable:
    """Iterator kernel over two columns of flat rings; a row without vertices in either gives null."""

    def kernel(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for a, b in batches:
            x, y = Lists.of(a), Lists.of(b)
            known = (x.n > 0) & (y.n > 0)
            xs, ys = x[known], y[known]
            out = np.full(len(x), np.nan)
            out[known] = in_runs(lambda u, v: work(Rings(u), Rings(v)), xs.n * ys.n // 4, xs, ys)
            yield found(out, known, pa.float64())

    return kernel


def crossing_kernel(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Over flat rings and the vertices of each of them: whether one crosses itself; null for a null row."""
    for flat, sizes in batches:
        known = flat.is_valid().to_numpy(zero_copy_only=False)
        x, n = Lists.of(flat), Lists.of(sizes)
        each = np.where(np.repeat(known, n.n), n.values, 0).astype(np.int64)
        of = np.repeat(np.arange(len(n)), n.n)
        hit = in_runs(lambda rs: crossing(Rings(rs)), each * each, Lists(x.values, 2 * each), empty=np.zeros(0, bool))
        yield found(np.bincount(of, hit, len(x)) > 0, known, pa.bool_())


def inside_kernel(margin: float) -> Callable:
    def kernel(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for rings, px, py in batches:
            yield pa.array(within(Rings(Lists.of(rings)), np.column_stack([numbers(px), numbers(py)]), margin), pa.bool_())

    return kernel


def shape_columns(flat: pa.Array, sizes: pa.Array, kind: pa.Array) -> tuple[Lists, Lists, np.ndarray]:
    return Lists.of(flat), Lists.of(sizes), kind.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def shape_pairs(work: Callable[[Shapes, Shapes], np.ndarray]) -> Callable:
    """Iterator kernel over two columns of shapes; a row without vertices in either gives null."""

    def kernel(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = [*shape_columns(*batch[:3]), *shape_columns(*batch[3:])]
            known = (columns[0].n > 0) & (columns[3].n > 0)
            picked = [c[known] for c in columns]
            out = np.full(len(known), np.nan)
            out[known] = in_runs(lambda *c: work(Shapes(*c[:3]), Shapes(*c[3:])), picked[0].n * picked[3].n // 4, *picked)
            yield found(out, known, pa.float64())

    return kernel


def shape_holds(margin: float) -> Callable:
    def kernel(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for flat, sizes, kind, px, py in batches:
            shapes = Shapes(*shape_columns(flat, sizes, kind))
            points = np.column_stack([numbers(px), numbers(py)])
            out = np.zeros(len(points), bool)
            some = np.flatnonzero(shapes.n > 0)
            near = nearest(points[some], some, shapes)
            out[some] = holds(shapes, points[some], some) | (near < margin)
            yield pa.array(out, pa.bool_())

    return kernel
