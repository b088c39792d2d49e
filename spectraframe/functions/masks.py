"""Mask algebra: run lengths, boxes, stability, point grids, crops, suppression (section 2.12)."""

from __future__ import annotations

import math

import numpy as np


def encode(mask: np.ndarray) -> list[int]:
    """Column-major run lengths, the first of zeros (0 if the first pixel is set)."""
    flat = mask.ravel(order="F")
    cuts = np.flatnonzero(np.diff(flat)) + 1
    edges = np.concatenate([[0] if flat.size and flat[0] else [], [0], cuts, [flat.size]]).astype(int)
    return np.diff(edges).tolist()


def decode(size: tuple[int, int], counts: list[int]) -> np.ndarray:
    flat = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
    return flat.reshape(size, order="F")


def area(counts: list[int]) -> int:
    """A31."""
    return int(sum(counts[1::2]))


def coco_string(counts: list[int]) -> str:
    """The compressed form: each count less the one two before it, in groups of five bits from the lowest, a sixth bit
    for more to come, offset to printable characters."""
    out = []
    for k, c in enumerate(counts):
        x = c - counts[k - 2] if k > 2 else c
        more = True
        while more:
            five = x & 31
            x >>= 5
            more = x != (-1 if five & 16 else 0)
            out.append(chr(48 + (five | 32 * more)))
    return "".join(out)


def box(mask: np.ndarray) -> list[int]:
    """Inclusive x0, y0, x1, y1; zeros for an empty mask."""
    y, x = np.nonzero(mask)
    return [int(x.min()), int(y.min()), int(x.max()), int(y.max())] if len(y) else [0, 0, 0, 0]


def stability(logits: np.ndarray, threshold: float, offset: float) -> float:
    """A29."""
    low = int((logits > threshold - offset).sum())
    return int((logits > threshold + offset).sum()) / low if low else 0.0


def xywh(b: list[float]) -> list[float]:
    """P19."""
    return [b[0], b[1], b[2] - b[0], b[3] - b[1]]


def near_crop_edge(boxes: np.ndarray, crop: list[int], image: list[int], atol: float = 20.0) -> np.ndarray:
    """boxes (in crop coordinates) with a side near the crop's edge but not near the image's."""
    whole = np.asarray(boxes, float).reshape(-1, 4) + [crop[0], crop[1], crop[0], crop[1]]
    return ((np.abs(whole - np.asarray(crop, float)) <= atol) & ~(np.abs(whole - np.asarray(image, float)) <= atol)).any(1)


def point_grid(n: int) -> np.ndarray:
    """N by n points in the middle of cells of the unit square, x fastest."""
    at = (np.arange(n) + 0.5) / n
    x, y = np.meshgrid(at, at)
    return np.stack([x.ravel(), y.ravel()], 1)


def layer_grids(n: int, layers: int, scale: int) -> list[np.ndarray]:
    return [point_grid(int(n / scale**k)) for k in range(layers + 1)]


def crop_boxes(size: tuple[int, int], layers: int, overlap: float) -> list[tuple[list[int], int]]:
    """X11: (box, layer): the image, then (2 ** layer) ** 2 overlapping boxes a layer, x outermost."""
    h, w = size
    out = [([0, 0, w, h], 0)]
    for layer in range(1, layers + 1):
        n = 2**layer
        shared = int(overlap * min(h, w) * 2 / n)
        bw, bh = (math.ceil((shared * (n - 1) + length) / n) for length in (w, h))
        for i in range(n):
            for j in range(n):
                x, y = int((bw - shared) * i), int((bh - shared) * j)
                out.append(([x, y, min(x + bw, w), min(y + bh, h)], layer))
    return out


def iou(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.asarray(a, float).reshape(-1, 1, 4), np.asarray(b, float).reshape(1, -1, 4)
    side = np.maximum(0, np.minimum(a[..., 2:], b[..., 2:]) - np.maximum(a[..., :2], b[..., :2]))
    both = side[..., 0] * side[..., 1]
    sizes = [np.maximum(0, x[..., 2] - x[..., 0]) * np.maximum(0, x[..., 3] - x[..., 1]) for x in (a, b)]
    return np.divide(both, sizes[0] + sizes[1] - both, out=np.zeros(both.shape), where=sizes[0] + sizes[1] - both > 0)


def nms(boxes: np.ndarray, scores: np.ndarray, threshold: float) -> list[int]:
    """Indices kept, the best first; a box that overlaps a kept one by more than threshold goes."""
    left = np.argsort(-np.asarray(scores, float), kind="stable")
    boxes = np.asarray(boxes, float).reshape(-1, 4)
    kept = []
    while left.size:
        kept.append(int(left[0]))
        left = left[1:][iou(boxes[left[:1]], boxes[left[1:]])[0] <= threshold]
    return kept


def longest_side(h: int, w: int, target: int) -> tuple[int, int]:
    """P20: the size whose longer side is target, rounded half up."""
    scale = target / max(h, w)
    return int(h * scale + 0.5), int(w * scale + 0.5)


def scale_points(points: np.ndarray, size: tuple[int, int], target: int) -> np.ndarray:
    """P20 for (x, y) coordinates."""
    h, w = longest_side(*size, target)
    return np.asarray(points, float) * [w / size[1], h / size[0]]


def normalized_square(image: np.ndarray, side: int, mean: tuple[float, float, float], std: tuple[float, float, float]) -> np.ndarray:
    """(image - mean) / std by channel, padded with zeros below and to the right."""
    x = (np.asarray(image, float) - mean) / std
    return np.pad(x, ((0, side - x.shape[0]), (0, side - x.shape[1]), (0, 0)))


def choose_single(ious: np.ndarray, n_points: int) -> int:
    """Which mask to return: the first is preferred for few points, never for many."""
    weight = np.zeros(len(ious))
    weight[0] = 1000
    return int(np.argmax(np.asarray(ious) + (n_points - 2.5) * weight))


def batches(size: int, *columns: list) -> list[tuple]:
    """Equally long columns in batches of so many rows."""
    if len({len(c) for c in columns}) > 1:
        raise ValueError(f"columns of different lengths: {[len(c) for c in columns]}")
    return [tuple(c[k : k + size] for c in columns) for k in range(0, len(columns[0]) if columns else 0, size)]


def restore_logits(logits: np.ndarray, padded: int, inner: tuple[int, int], original: tuple[int, int]) -> np.ndarray:
    """Low-resolution logits (n, h, w) scaled to the padded square, its padding cut off, scaled to the image's size."""
    from .raster import sample

    def scaled(a: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        rows, cols = ((np.arange(m) + 0.5) * n / m - 0.5 for n, m in zip(a.shape, shape, strict=True))
        return sample(a, *np.meshgrid(rows.clip(0, a.shape[0] - 1), cols.clip(0, a.shape[1] - 1), indexing="ij"))

    return np.stack([scaled(scaled(x, (padded, padded))[: inner[0], : inner[1]], original) for x in np.asarray(logits, float)])
