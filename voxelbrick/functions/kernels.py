"""NumPy work on single bricks. Arrays are indexed z, y, x; coordinates are voxel indices, continuous where said."""

from __future__ import annotations

import numpy as np


def packed(a: np.ndarray) -> tuple[str, bytes]:
    """(dtype, bytes) of an array, in C order."""
    return str(a.dtype), np.ascontiguousarray(a).tobytes()


def unpacked(row) -> np.ndarray:
    """The array of a brick row (dtype, data, nz, ny, nx)."""
    return np.frombuffer(row.data, row.dtype).reshape(row.nz, row.ny, row.nx)


def given(row) -> np.ndarray:
    """Which voxels of a brick row had a row: its mask, or all if it has none."""
    mask = getattr(row, "mask", None)
    shape = (int(row.nz), int(row.ny), int(row.nx))
    return np.ones(shape, bool) if mask is None else np.frombuffer(mask, bool).reshape(shape)


def masked(there: np.ndarray) -> bytes | None:
    """given()'s inverse."""
    return None if there.all() else np.ascontiguousarray(there).tobytes()


def _neighbours(c: np.ndarray, n: int, origin: int, size: int, mode: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of coordinates along one axis: the index in src and the weight of each neighbour; weight 0 where they are outside the volume.

    Neighbours are clamped to the volume's edge; those outside src get weight 0, as voxels that count as 0."""
    inside = (c >= -0.5) & (c < n - 0.5)
    low = np.floor(c + 0.5 if mode == "nearest" else c).astype(np.int64)
    frac = c - low
    out = []
    for i, w in ((low, np.ones(len(c))),) if mode == "nearest" else ((low, 1 - frac), (low + 1, frac)):
        k = np.clip(i, 0, n - 1) - origin
        ok = (k >= 0) & (k < size)
        w = np.where(ok & inside, w, 0)
        if w.any():
            out.append((np.where(ok, k, 0), w))
    return out


def sample(src: np.ndarray, origin, shape, coords: np.ndarray, mode: str = "linear") -> np.ndarray:
    """Values of a volume of `shape` at continuous coords (3, n), from src, a box of it that starts at origin.

    A point inside [-0.5, n - 0.5) on every axis takes its neighbours clamped to the volume's edge; any other is 0.
    Voxels outside src count as 0: the caller gives a box that covers what the points need."""
    return samples([src], origin, shape, coords, mode)[0]


def samples(boxes: list[np.ndarray], origin, shape, coords: np.ndarray, mode: str = "linear") -> list[np.ndarray]:
    """sample() of several arrays on one box at the same coords: neighbours and weights are worked out once."""
    axes = [_neighbours(np.asarray(c), int(n), int(o), k, mode) for c, n, o, k in zip(coords, shape, origin, boxes[0].shape, strict=True)]
    flat, (_, ny, nx) = [b.ravel() for b in boxes], boxes[0].shape
    out = [np.zeros(coords.shape[1]) for _ in boxes]
    for z, wz in axes[0]:
        for y, wy in axes[1]:
            row, w2 = (z * ny + y) * nx, wz * wy
            for x, wx in axes[2]:
                w, at = w2 * wx, row + x
                some = w != 0
                every = some.all()
                for v, a in zip(out, flat, strict=True):
                    part = a.take(at) * w
                    v += part if every else np.where(some, part, 0)
    return out


def sample_box(src: np.ndarray, origin, shape, m: np.ndarray, t: np.ndarray, start, size, mode: str = "linear") -> np.ndarray:
    """sample() at m . i + t for the indices i of a box. A diagonal m is done axis by axis."""
    if (m == np.diag(np.diag(m))).all():
        out = src.astype(np.float64, copy=False)
        for a in range(3):
            c = m[a, a] * np.arange(start[a], start[a] + size[a]) + t[a]
            near = _neighbours(c, int(shape[a]), int(origin[a]), src.shape[a], mode)
            wide = [-1 if i == a else 1 for i in range(3)]
            total = np.zeros([len(c) if i == a else n for i, n in enumerate(out.shape)])
            for k, w in near:
                part = out.take(k, axis=a)
                total += part if (w == 1).all() else np.where(w.reshape(wide) != 0, part * w.reshape(wide), 0)
            out = total
        return out
    return sample(src, origin, shape, m @ grid(start, size) + np.asarray(t)[:, None], mode).reshape(size)


def grid(start, size) -> np.ndarray:
    """The indices of a box, (3, n) in C order."""
    axes = [np.arange(a, a + n, dtype=np.float64) for a, n in zip(start, size, strict=True)]
    return np.stack([g.ravel() for g in np.meshgrid(*axes, indexing="ij")])


def cosine_ramp(n: int, overlap: int, low: float = 1e-4) -> np.ndarray:
    """Raised-cosine weights along one axis: ramps of min(overlap, n // 2) at both ends, 1 between, low at least where there is a ramp."""
    reach = min(overlap, n // 2)
    if reach <= 0:
        return np.ones(n)
    to_edge = np.minimum(np.arange(n), np.arange(n)[::-1])
    return np.where(to_edge < reach, np.maximum(0.5 * (1 - np.cos(np.pi * to_edge / reach)), low), 1.0)


def box_weights(sizes, overlaps) -> np.ndarray:
    """The product of the three axes' weights."""
    z, y, x = map(cosine_ramp, sizes, overlaps)
    return z[:, None, None] * y[:, None] * x
