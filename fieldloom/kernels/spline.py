"""Bicubic displacement fields over a picture, as arrays: basis, inverse, smoothness, folds."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class Lattice:
    """Control points every ``spacing`` pixels over a picture, one beyond each edge; coefficients are rows of x and y shifts."""

    width: int
    height: int
    spacing: float

    @property
    def nx(self) -> int:
        return int((self.width - 1) // self.spacing) + 4

    @property
    def ny(self) -> int:
        return int((self.height - 1) // self.spacing) + 4

    @property
    def size(self) -> int:
        return self.nx * self.ny

    def start(self, affine: np.ndarray) -> np.ndarray:
        """The coefficients of an affine map (xx, xy, yx, yy, x, y)."""
        px, py = np.meshgrid((np.arange(self.nx) - 1) * self.spacing, (np.arange(self.ny) - 1) * self.spacing)
        xx, xy, yx, yy, ox, oy = affine
        return np.stack([(xx - 1) * px + xy * py + ox, yx * px + (yy - 1) * py + oy], axis=-1).reshape(-1, 2)

    def design(self, x: np.ndarray, y: np.ndarray, dx: int = 0, dy: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The 16 control points of each place and their weights, or those of a derivative."""
        (i, wx), (j, wy) = _weights(x / self.spacing, dx, self.nx), _weights(y / self.spacing, dy, self.ny)
        at = (j[:, None] + np.arange(4))[:, :, None] * self.nx + (i[:, None] + np.arange(4))[:, None, :]
        w = wy[:, :, None] * wx[:, None, :] / self.spacing ** (dx + dy)
        return at.reshape(len(x), 16), w.reshape(len(x), 16)

    def products(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 10 different products of two of the 4 weights of each place, along x and along y."""
        (_, wx), (_, wy) = _weights(x / self.spacing, 0, self.nx), _weights(y / self.spacing, 0, self.ny)
        a, b = np.triu_indices(4)
        return wx[:, a] * wx[:, b], wy[:, a] * wy[:, b]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of the 256 pairs of the 16 control points: both as steps from the first of the 16, and the place of its product among the 10 along y by 10 along x."""
        of = np.zeros((4, 4), int)
        of[np.triu_indices(4)] = np.arange(10)
        of = np.maximum(of, of.T)
        j, i = (a.ravel() for a in np.meshgrid(np.arange(4), np.arange(4), indexing="ij"))
        at = j * self.nx + i
        first, second = np.repeat(np.arange(16), 16), np.tile(np.arange(16), 16)
        return at[first], at[second], of[j[first], j[second]] * 10 + of[i[first], i[second]]

    def moved(self, c: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the field takes each place."""
        at, w = self.design(x, y)
        d = np.einsum("nk,nkc->nc", w, c[at])
        return x + d[:, 0], y + d[:, 1]

    def jacobian(self, c: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The derivatives of the moved place, 2 by 2 for each."""
        out = np.broadcast_to(np.eye(2), (len(x), 2, 2)).copy()
        for k, (a, b) in enumerate(((1, 0), (0, 1))):
            at, w = self.design(x, y, a, b)
            out[:, :, k] += np.einsum("nk,nkc->nc", w, c[at])
        return out

    def inverse(self, c: np.ndarray, u: np.ndarray, v: np.ndarray, rounds: int = 25) -> np.ndarray:
        """The places that the field takes to (u, v), NaN where none is found in the picture, by Newton steps halved while they do not help."""
        goal, at = np.stack([u, v], axis=1), np.stack([u, v], axis=1).astype(float)
        top = np.array([self.width - 1.0, self.height - 1.0])
        at = np.clip(at, 0, top)
        off = lambda p: np.stack(self.moved(c, p[:, 0], p[:, 1]), axis=1) - goal
        rest = off(at)
        for _ in range(rounds):
            far = np.hypot(*rest.T) > 1e-9
            if not far.any():
                break
            jac = self.jacobian(c, at[far, 0], at[far, 1])
            good = np.abs(np.linalg.det(jac)) > 1e-12
            step = np.zeros((far.sum(), 2))
            step[good] = np.linalg.solve(jac[good], rest[far][good][..., None])[..., 0]
            share, best, kept = np.ones(len(step)), at[far].copy(), rest[far].copy()
            open_ = np.ones(len(step), bool)
            for _ in range(8):
                trial = np.clip(at[far] - share[:, None] * step, 0, top)
                err = off_at = np.stack(self.moved(c, trial[:, 0], trial[:, 1]), axis=1) - goal[far]
                better = open_ & (np.hypot(*off_at.T) < np.hypot(*kept.T))
                best[better], kept[better] = trial[better], err[better]
                open_ &= ~better
                share[open_] /= 2
            at[far], rest[far] = best, kept
        at[np.hypot(*rest.T) > 1e-6] = np.nan
        return at

    def bending(self) -> np.ndarray:
        """The sum of squares of the second differences of neighbouring coefficients, as a matrix."""
        def second(n: int) -> np.ndarray:
            d = np.zeros((n - 2, n))
            for k in range(n - 2):
                d[k, k : k + 3] = 1, -2, 1
            return d.T @ d

        return np.kron(np.eye(self.ny), second(self.nx)) + np.kron(second(self.ny), np.eye(self.nx))

    def folds(self, c: np.ndarray, tau: float = 0.05, steps: int = 4) -> tuple[bool, float, float, str | None]:
        """Whether the field maps the picture one to one: sound, least determinant and stretch over a grid, and what is wrong.

        Determinants and stretches are positive, no triangle of the moved grid is turned over, and its border does not
        cross itself; then none of the inside overlaps. Where the least stretch is near ``tau`` the grid is doubled once.
        """
        for fine in (steps, 2 * steps):
            gx, gy, x, y, maps = _grid(self, fine)
            # The shifts and their derivatives along x and y at every place of the grid.
            shift, along, down = (maps @ c).reshape(3, len(x), 2)
            xx, xy, yx, yy = along[:, 0] + 1, down[:, 0], along[:, 1], down[:, 1] + 1
            dets = xx * yy - xy * yx
            widest = (np.hypot(xx + yy, yx - xy) + np.hypot(xx - yy, yx + xy)) / 2
            det, stretch = float(dets.min()), float((np.abs(dets) / np.maximum(widest, 1e-300)).min())
            if det <= 0 or stretch <= tau:
                return False, det, stretch, "determinant" if det <= 0 else "stretch"
            u, v = (a.reshape(len(gy), len(gx)) for a in (x + shift[:, 0], y + shift[:, 1]))
            area = lambda a, b, d: (u[b] - u[a]) * (v[d] - v[a]) - (v[b] - v[a]) * (u[d] - u[a])  # noqa: E731, B023
            o, r, b, d = (slice(None, -1), slice(None, -1)), (slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1)), (slice(1, None), slice(1, None))
            if min(area(o, r, d).min(), area(o, d, b).min()) <= 0:
                return False, det, stretch, "triangle"
            ring = np.concatenate([np.stack([u[0], v[0]], 1)[:-1], np.stack([u[:, -1], v[:, -1]], 1)[:-1], np.stack([u[-1, ::-1], v[-1, ::-1]], 1)[:-1], np.stack([u[::-1, 0], v[::-1, 0]], 1)[:-1]])
            if _crosses_itself(ring):
                return False, det, stretch, "border"
            if stretch > 2 * tau:
                break
        return True, det, stretch, None


def _weights(t: np.ndarray, derivative: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.clip(np.floor(t).astype(int), 0, n - 4)
    f = t - i
    if derivative:
        w = [-((1 - f) ** 2) / 2, (3 * f * f - 4 * f) / 2, (-3 * f * f + 2 * f + 1) / 2, f * f / 2]
    else:
        w = [(1 - f) ** 3 / 6, (3 * f**3 - 6 * f * f + 4) / 6, (-3 * f**3 + 3 * f * f + 3 * f + 1) / 6, f**3 / 6]
    return i, np.stack(w, axis=1)


@lru_cache(maxsize=8)
def _grid(lattice: Lattice, fine: int) -> tuple[np.ndarray, ...]:
    """The columns and rows of a grid of ``fine`` steps to a cell, its places, and the matrix that takes coefficients to the shifts there and to their derivatives."""
    gx, gy = np.linspace(0, lattice.width - 1, (lattice.nx - 3) * fine + 1), np.linspace(0, lattice.height - 1, (lattice.ny - 3) * fine + 1)
    x, y = (a.ravel() for a in np.meshgrid(gx, gy))
    maps = np.zeros((3, len(x), lattice.size))
    for k, (dx, dy) in enumerate(((0, 0), (1, 0), (0, 1))):
        at, w = lattice.design(x, y, dx, dy)
        maps[k, np.arange(len(x))[:, None], at] = w
    return gx, gy, x, y, maps.reshape(-1, lattice.size)


def _crosses_itself(ring: np.ndarray) -> bool:
    (x, y), (dx, dy) = ring.T, (np.roll(ring, -1, axis=0) - ring).T
    # On which side of each edge every corner lies; the end of an edge is the next corner.
    side = dx[:, None] * (y[None] - y[:, None]) - dy[:, None] * (x[None] - x[:, None])
    parted = side * np.roll(side, -1, axis=1) < -1e-10
    return bool((parted & parted.T).any())


def rigid(q: np.ndarray, z: np.ndarray, w: np.ndarray) -> tuple[complex, complex]:
    """The turn and shift that take the complex places ``q`` nearest to ``z`` by weight."""
    mq, mz = (w * q).sum() / w.sum(), (w * z).sum() / w.sum()
    turn = np.exp(1j * np.angle((w * np.conj(q - mq) * (z - mz)).sum()))
    return turn, mz - turn * mq


def robust_rigid(q: np.ndarray, z: np.ndarray, own: np.ndarray, limit: float, rounds: int = 8) -> tuple[complex, complex, np.ndarray]:
    """As ``rigid``, points further off than ``limit`` weighing less; also the last weights."""
    w = own
    for _ in range(rounds):
        turn, shift = rigid(q, z, w)
        w = own * np.minimum(1, limit / np.maximum(np.abs(shift + turn * q - z), 1e-20))
    return turn, shift, w


def robust_rigids(q: np.ndarray, z: np.ndarray, own: np.ndarray, starts: np.ndarray, limit: float, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The turns and shifts of ``robust_rigid`` of many runs of points at once; ``starts`` has the first place of each run, none is empty."""
    sizes = np.diff(np.append(starts, len(q)))
    run = np.repeat(np.arange(len(starts)), sizes)
    # About the middle of each run, so that sums of products keep their digits.
    cq, cz = np.add.reduceat(q, starts) / sizes, np.add.reduceat(z, starts) / sizes
    p, y = q - cq[run], z - cz[run]
    both = np.conj(p) * y
    terms = np.stack([np.ones(len(q)), p.real, p.imag, y.real, y.imag, both.real, both.imag])
    w = own
    for k in range(rounds):
        sw, pr, pi, yr, yi, br, bi = np.add.reduceat(terms * w, starts, axis=1)
        mp, my = (pr + 1j * pi) / sw, (yr + 1j * yi) / sw
        turn = np.exp(1j * np.angle(br + 1j * bi - sw * np.conj(mp) * my))
        shift = my - turn * mp
        if k + 1 < rounds:
            w = own * np.minimum(1, limit / np.maximum(np.abs(shift[run] + turn[run] * p - y), 1e-20))
    return turn, shift + cz - turn * cq
