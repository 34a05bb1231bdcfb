"""Sums over all pairs of points by distance, without comparing most of them.

Places are put into the cells of one grid.  Where all pairs of two cells fall
into one bin, their number and their sum of half squared differences follow
from the cells' sums, and their sum of distances from the cells' moments (a
series that is exact to about 1e-10 from NEAR cells on); such cells are summed
up for all offsets at once by a Fourier transform.  Cells across a bin's limit,
and near ones, are compared place by place.
"""

from __future__ import annotations

import math

import numpy as np

ORDER = 6  # of the moments
NEAR = 8  # cells
GRID = 256  # cells along a side, at most
LANES = 32  # places of a cell that are compared at once, at most
CHUNK = 1 << 18  # numbers of a matrix worked on at once
POWERS = [(i, d - i) for d in range(ORDER + 1) for i in range(d + 1)]


def hull(xy: np.ndarray) -> np.ndarray:
    """The corners of the convex hull."""
    rows = np.unique(xy, axis=0).tolist()
    out = []
    for way in (rows, rows[::-1]):
        line = []
        for p in way:
            while len(line) > 1 and (line[-1][0] - line[-2][0]) * (p[1] - line[-2][1]) <= (line[-1][1] - line[-2][1]) * (p[0] - line[-2][0]):
                line.pop()
            line.append(p)
        out += line
    return np.array(out, dtype=float).reshape(-1, 2)


class Offsets:
    """What the pairs of two cells have in common, by the offset of the cells (grid x grid, wrapped)."""

    def __init__(self, grid: int, side: float, cuts: np.ndarray):
        """``cuts`` are the limits between bins."""
        self.grid, self.side, self.cuts = grid, side, cuts
        step = np.fft.ifftshift(np.arange(-grid, grid))
        self.x, self.y = np.meshgrid(step, step, indexing="ij")
        low = side * np.hypot(np.maximum(np.abs(self.x) - 1, 0), np.maximum(np.abs(self.y) - 1, 0)) * (1 - 1e-9)
        high = side * np.hypot(np.abs(self.x) + 1, np.abs(self.y) + 1) * (1 + 1e-9)
        self.first, self.last = np.searchsorted(cuts, low, side="right"), np.searchsorted(cuts, high, side="right")
        self.ahead = (self.x > 0) | ((self.x == 0) & (self.y > 0))  # of two opposite offsets one
        self.direct = (self.first != self.last) | (np.hypot(self.x, self.y) < NEAR)

    def far_sums(self, moments: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number, distances and half squared differences (3 x bins) of the pairs that need no comparison.

        ``moments[i, j]`` are sums over a cell's places of dx^i dy^j, in sides
        from its middle; ``a`` and ``b`` those of z and z^2.
        """
        size = (2 * self.grid, 2 * self.grid)
        turn = lambda plane: np.fft.fft2(plane, size)
        back = lambda hat: np.fft.ifft2(hat)
        flat = {}
        for j, m in POWERS:  # of (dx + i dy)^j (dx - i dy)^m
            terms = np.polymul(np.polynomial.polynomial.polypow([1, 1j], j)[::-1], np.polynomial.polynomial.polypow([1, -1j], m)[::-1])[::-1]
            flat[j, m] = turn(sum(c * moments[j + m - t, t] for t, c in enumerate(terms)))
        n, za, zb = flat[0, 0], turn(a), turn(b)
        pairs = np.rint(back(n.conj() * n).real)
        half = back(0.5 * (n.conj() * zb + zb.conj() * n) - za.conj() * za).real
        place = np.where(self.direct, 1.0, self.x + 1j * self.y)
        series = [math.prod((0.5 - i) / (i + 1) for i in range(j)) for j in range(ORDER + 1)]  # of sqrt(1 + u)
        far = np.zeros(size)
        for j, m in POWERS:
            hat = sum(math.comb(j, p) * math.comb(m, q) * (-1) ** (p + q) * flat[q, p].conj() * flat[j - p, m - q] for p in range(j + 1) for q in range(m + 1))
            far += series[j] * series[m] * (back(hat) / (place**j * place.conj() ** m)).real
        far *= self.side * np.abs(place)
        use = self.ahead & ~self.direct
        return np.stack([np.bincount(self.first[use], v[use], len(self.cuts) + 1).astype(float) for v in (pairs, far, half)])

    def near_sums(self, one: np.ndarray, other: np.ndarray, same: bool) -> np.ndarray:
        """The same of the pairs to be compared, between two blocks (cell, x, y, n, sums of z and z^2) or in one.

        Of two blocks the cells of the first have the smaller numbers.
        """
        bins = np.zeros((3, len(self.cuts) + 1))
        (p, p_at), (q, q_at) = self._lanes(one), self._lanes(other)
        p_cells = np.flatnonzero(np.diff(p_at))
        q_cells = np.flatnonzero(np.diff(q_at))
        pi, pj, qi, qj = p_cells // self.grid, p_cells % self.grid, q_cells // self.grid, q_cells % self.grid
        for x in range(int(qi.min() - pi.max()), int(qi.max() - pi.min()) + 1):
            for y in range(int(qj.min() - pj.max()), int(qj.max() - pj.min()) + 1):
                if not self.direct[x, y] or not (self.ahead[x, y] or (same and x == y == 0)):
                    continue
                ok = (pj + y >= 0) & (pj + y < self.grid) & (pi + x >= 0) & (pi + x < self.grid)
                c = p_cells[ok]
                d = c + x * self.grid + y
                rows, columns = np.diff(p_at)[c], np.diff(q_at)[d]
                left = np.repeat(np.arange(len(c)), rows * columns)
                if not len(left):
                    continue
                k = np.arange(len(left)) - np.repeat(np.cumsum(rows * columns) - rows * columns, rows * columns)
                left, right = p_at[c][left] + k // columns[left], q_at[d][left] + k % columns[left]
                step = max(1, CHUNK // (p.shape[2] * q.shape[2]))
                for s in range(0, len(left), step):
                    found = self._compared(p[:, left[s : s + step]], q[:, right[s : s + step]], self.first[x, y], self.last[x, y])
                    bins += 0.5 * found if x == y == 0 else found
        return bins

    def _lanes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places as 5 x lines x lanes, a line of one cell, and where each cell's lines start."""
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        cell = rows[:, 0].astype(np.int64)
        n = np.bincount(cell, minlength=self.grid**2)
        lanes = int(np.clip(np.quantile(n[n > 0], 0.9), 4, LANES))
        lines = -(-n // lanes)
        at = np.concatenate(([0], np.cumsum(lines)))
        k = np.arange(len(rows)) - (np.cumsum(n) - n)[cell]
        out = np.zeros((5, at[-1], lanes))
        out[:, at[cell] + k // lanes, k % lanes] = rows[:, 1:].T
        return out, at

    def _compared(self, p: np.ndarray, q: np.ndarray, first: int, last: int) -> np.ndarray:
        h = (p[0][:, :, None] - q[0][:, None, :]) ** 2
        h += (p[1][:, :, None] - q[1][:, None, :]) ** 2
        np.sqrt(h, out=h)
        weights = np.stack(q[2:], 2)

        def sums(below: np.ndarray | float) -> np.ndarray:
            far = (h * below) @ weights[:, :, :1]
            met = below @ weights if isinstance(below, np.ndarray) else np.broadcast_to(weights.sum(1)[:, None], (*p.shape[1:], 3))
            half = 0.5 * ((p[4] * met[:, :, 0]).sum() + (p[2] * met[:, :, 2]).sum()) - (p[3] * met[:, :, 1]).sum()
            return np.array([(p[2] * met[:, :, 0]).sum(), (p[2] * far[:, :, 0]).sum(), half])

        out, before = np.zeros((3, len(self.cuts) + 1)), 0.0
        for c in range(first, last):
            now = sums((h < self.cuts[c]).astype(float))
            out[:, c] += now - before
            before = now
        out[:, last] += sums(1.0) - before
        return out
