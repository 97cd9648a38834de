"""Array kernels on batches of small gray pictures."""

from __future__ import annotations

import numpy as np


def laplacian(gray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per picture (axes: picture, row, column): variance of the four-neighbour Laplacian and deviation of the light, both inside."""
    g = gray.astype(float)
    inner = g[:, 1:-1, 1:-1]
    lap = 4 * inner - g[:, :-2, 1:-1] - g[:, 2:, 1:-1] - g[:, 1:-1, :-2] - g[:, 1:-1, 2:]
    return lap.var(axis=(1, 2)), inner.std(axis=(1, 2))


def halved(gray: np.ndarray, missing: int = -1) -> np.ndarray:
    """The next pyramid level: means of two by two, rounded down at a half up; missing where any is missing."""
    h, w = gray.shape[1] // 2 * 2, gray.shape[2] // 2 * 2
    four = gray[:, :h, :w].astype(int).reshape(len(gray), h // 2, 2, w // 2, 2)
    out = (four.sum(axis=(2, 4)) + 2) // 4
    out[(four == missing).any(axis=(2, 4))] = missing
    return out


def high_pass(gray: np.ndarray, radius: int = 5) -> np.ndarray:
    """The picture less the mean of its surroundings, by summed-area tables."""
    g = gray.astype(float)
    n, h, w = g.shape
    table = np.zeros((n, h + 1, w + 1))
    table[:, 1:, 1:] = g.cumsum(1).cumsum(2)
    top, bottom = np.clip(np.arange(h) - radius, 0, h), np.clip(np.arange(h) + radius + 1, 0, h)
    left, right = np.clip(np.arange(w) - radius, 0, w), np.clip(np.arange(w) + radius + 1, 0, w)
    total = table[:, bottom][:, :, right] - table[:, top][:, :, right] - table[:, bottom][:, :, left] + table[:, top][:, :, left]
    return g - total / ((bottom - top)[:, None] * (right - left)[None])


def phase_shift(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shift from ``a`` to ``b`` in x and y with sub-pixel peaks, and how many deviations the peak is above the rest."""
    n, h, w = a.shape
    hann = np.hanning(h + 2)[1:-1, None] * np.hanning(w + 2)[None, 1:-1]
    size = (2 * h, 2 * w)
    fa, fb = (np.fft.fft2(high_pass(p) * hann, size) for p in (a, b))
    cross = np.conj(fa) * fb
    power = np.abs(cross)
    flat = np.fft.ifft2(cross / (power + 1e-3 * power.mean(axis=(1, 2), keepdims=True) + 1e-12)).real
    peak = flat.reshape(n, -1).argmax(axis=1)
    row, col = np.divmod(peak, 2 * w)
    k = np.arange(n)
    at = flat[k, row, col]

    def fine(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        bend = low - 2 * at + high
        return np.clip(np.where(bend < 0, (low - high) / (2 * np.where(bend < 0, bend, -1.0)), 0.0), -0.5, 0.5)

    dy = row + fine(flat[k, row - 1, col], flat[k, (row + 1) % size[0], col])
    dx = col + fine(flat[k, row, col - 1], flat[k, row, (col + 1) % size[1]])
    dx, dy = np.where(dx > w, dx - 2 * w, dx), np.where(dy > h, dy - 2 * h, dy)
    spread = flat.std(axis=(1, 2))
    return dx, dy, np.where(spread > 0, (at - flat.mean(axis=(1, 2))) / np.where(spread > 0, spread, 1), 0.0)


def feather_weights(allowed: np.ndarray, share: float = 0.1) -> np.ndarray:
    """8-bit blend weights of one mask by the 3-4 chamfer distance to what is not allowed and to the edge."""
    h, w = allowed.shape
    x, y = np.arange(w)[None], np.arange(h)[:, None]
    d = np.where(allowed, np.minimum(0xFFFF, 3 * np.minimum(np.minimum(x + 1, w - x), np.minimum(y + 1, h - y))), 0).astype(int)
    for rows, side in ((range(h), 1), (range(h - 1, -1, -1), -1)):
        for r in rows:
            if 0 <= r - side < h:
                above = d[r - side]
                d[r] = np.minimum(d[r], above + 3)
                d[r, 1:] = np.minimum(d[r, 1:], above[:-1] + 4)
                d[r, :-1] = np.minimum(d[r, :-1], above[1:] + 4)
            # Along the row a step costs 3: a running minimum of d - 3 x.
            line = d[r] if side > 0 else d[r, ::-1]
            line[:] = np.minimum.accumulate(line - 3 * np.arange(w)) + 3 * np.arange(w)
    depth = min(w * max(0.0, share), max(0.0, (min(w, h) - 1) / 2))
    if not depth:
        return np.where(d > 0, 255, 0).astype(np.uint8)
    t = np.clip((d / 3 - 0.5) / depth, 0, 1)
    return np.where(d > 0, np.floor(255 * t * t * (3 - 2 * t) + 0.5), 0).astype(np.uint8)


def box_filled(field: np.ndarray, known: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """A field with unknown cells filled from the mean of their known neighbours, ring by ring."""
    out, have = np.where(known, field, 0.0), known.copy()
    for _ in range(rounds or sum(field.shape)):
        if have.all() or not have.any():
            break
        padded, there = np.pad(out * have, 1), np.pad(have.astype(float), 1)
        total = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:]
        count = there[:-2, 1:-1] + there[2:, 1:-1] + there[1:-1, :-2] + there[1:-1, 2:]
        new = ~have & (count > 0)
        out[new] = total[new] / count[new]
        have |= new
    return out
