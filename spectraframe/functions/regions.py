"""NumPy kernels on masks: components and their properties, morphology, holes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def label(mask: np.ndarray, connectivity: int = 8) -> tuple[np.ndarray, int]:
    """A1: components numbered in the order of their first pixel. Runs of each row are joined with those they touch in the
    row above."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    parent = list(range(len(row)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    reach = 1 if connectivity == 8 else 0
    first = np.searchsorted(row, np.arange(h + 1))
    for r in range(1, h):
        i, j = first[r - 1], first[r]
        while i < first[r] and j < first[r + 1]:
            if start[i] < end[j] + reach and start[j] < end[i] + reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(k) for k in range(len(row))], int)
    names, number = np.unique(roots, return_inverse=True)
    out = np.zeros((h, w), np.int32)
    for r, s, e, n in zip(row, start, end, number, strict=True):
        out[r, s:e] = n + 1
    return out, len(names)


def holding(stack: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Of each mask of a stack (n, h, w), the component (8 neighbours) of its pixel (row, column); none where that is off. All masks' runs are
    joined at once."""
    n, h, w = stack.shape
    wide = w + 2  # no run goes over a line's end, and no mask touches the next
    line = np.pad(stack, ((0, 0), (0, 1), (1, 1))).ravel().astype(np.int8)
    step = np.diff(line, prepend=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    first = np.searchsorted(end, start - wide)
    count = np.maximum(np.searchsorted(start, end - wide, "right") - first, 0)
    below = np.repeat(np.arange(len(start)), count)
    above = np.arange(len(below)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    root = np.arange(len(start))
    while len(below):
        a, b = root[below], root[above]
        open_ = a != b
        if not open_.any():
            break
        low = np.minimum(a, b)[open_]
        np.minimum.at(root, a[open_], low)
        np.minimum.at(root, b[open_], low)
        while not np.array_equal(up := root[root], root):
            root = up
    at = (np.arange(n) * (h + 1) + rows) * wide + cols + 1
    wanted = np.zeros(len(start), bool)
    wanted[root[np.searchsorted(start, at[line[at] == 1], "right") - 1]] = True
    kept = wanted[root]
    out = np.zeros(len(line), np.int8)
    out[start[kept]], out[end[kept]] = 1, -1
    return np.cumsum(out, dtype=np.int8).reshape(n, h + 1, wide)[:, :h, 1:-1].astype(bool)


@dataclass(frozen=True)
class Region:
    label: int
    area: int
    bbox: tuple[int, int, int, int]
    centroid: tuple[float, float]
    major: float
    minor: float
    perimeter: float


#: A border pixel's share of the perimeter by its neighbourhood's code (10 for each diagonal border
#: neighbour, 2 for each straight one, 1 for itself).
PERIMETER = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: 2**0.5, 33: 2**0.5, 13: (1 + 2**0.5) / 2, 23: (1 + 2**0.5) / 2}


def perimeter(mask: np.ndarray) -> float:
    p = np.pad(mask, 2)
    inner = p[1:-1, 1:-1]
    solid = inner & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    border = np.pad((inner & ~solid).astype(int), 1)
    h, w = border.shape
    code = np.zeros((h - 2, w - 2), int)
    for y in (0, 1, 2):
        for x in (0, 1, 2):
            code += (1 if y == x == 1 else 2 if 1 in (y, x) else 10) * border[y : y + h - 2, x : x + w - 2]
    n = np.bincount(code.ravel(), minlength=64)
    return float(sum(n[k] * v for k, v in PERIMETER.items()))


def regions(labels: np.ndarray, n: int) -> list[Region]:
    """A2: the properties of components 1 to n. Axes are those of the ellipse with the same second moments, a pixel's own
    included."""
    out = []
    rows, cols = np.nonzero(labels)
    of = labels[rows, cols]
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(1, n + 2))
    for k in range(n):
        at = order[cuts[k] : cuts[k + 1]]
        y, x = rows[at], cols[at]
        cy, cx = y.mean(), x.mean()
        a, c, b = ((y - cy) ** 2).mean() + 1 / 12, ((x - cx) ** 2).mean() + 1 / 12, ((y - cy) * (x - cx)).mean()
        mid, half = (a + c) / 2, np.sqrt(((a - c) / 2) ** 2 + b * b)
        box = (int(y.min()), int(x.min()), int(y.max()) + 1, int(x.max()) + 1)
        shape = labels[box[0] : box[2], box[1] : box[3]] == k + 1
        out.append(Region(k + 1, len(at), box, (float(cy), float(cx)), float(4 * np.sqrt(mid + half)), float(4 * np.sqrt(max(mid - half, 0))), perimeter(shape)))
    return out


def of(mask: np.ndarray) -> list[Region]:
    return regions(*label(mask))


def largest(found: list[Region]) -> Region | None:
    """The first of the largest."""
    return max(found, key=lambda r: (r.area, -r.label), default=None)


def remove_small(mask: np.ndarray, min_size: int, connectivity: int = 4) -> np.ndarray:
    """without components of fewer than min_size pixels."""
    labels, n = label(mask, connectivity)
    keep = np.bincount(labels.ravel(), minlength=n + 1) >= min_size
    keep[0] = False
    return keep[labels]


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """M2: background that no 4-path leads to from outside becomes part of the mask."""
    labels, _ = label(~np.pad(mask, 1), 4)
    return (labels != labels[0, 0])[1:-1, 1:-1]


def _swept(mask: np.ndarray, radius: int) -> np.ndarray:
    """Pixels within a disk of a pixel of the mask: for each row of the disk, one running sum."""
    h, w = mask.shape
    out = np.zeros((h + 2 * radius, w), bool)
    total = np.zeros((h, w + 1), np.int32)
    np.cumsum(mask, axis=1, out=total[:, 1:])
    col = np.arange(w)
    for dy in range(-radius, radius + 1):
        half = int(np.sqrt(radius * radius - dy * dy))
        hit = total[:, np.minimum(col + half + 1, w)] > total[:, np.maximum(col - half, 0)]
        out[radius + dy : radius + dy + h] |= hit
    return out[radius : radius + h]


def dilate(mask: np.ndarray, radius: int) -> np.ndarray:
    return _swept(mask, radius)


def erode(mask: np.ndarray, radius: int) -> np.ndarray:
    """Outside counts as part of the mask."""
    return ~_swept(~mask, radius)


def opening(mask: np.ndarray, radius: int) -> np.ndarray:
    return dilate(erode(mask, radius), radius)


def closing(mask: np.ndarray, radius: int) -> np.ndarray:
    return erode(dilate(mask, radius), radius)


def remove_small_regions(mask: np.ndarray, area: float, mode: str) -> tuple[np.ndarray, bool]:
    """Small holes filled (mode "holes") or small islands dropped ("islands"; the largest stays if all are small)."""
    if mode not in ("holes", "islands"):
        raise ValueError(mode)
    work = ~mask if mode == "holes" else mask
    labels, n = label(work, 8)
    sizes = np.bincount(labels.ravel(), minlength=n + 1)[1:]
    small = np.flatnonzero(sizes < area) + 1
    if not len(small):
        return mask, False
    if mode == "holes":
        return mask | np.isin(labels, small), True
    keep = np.flatnonzero(sizes >= area) + 1
    return np.isin(labels, keep if len(keep) else [int(np.argmax(sizes)) + 1]), True
