"""Segmentation and quality control of one image (section 2.10), on the kernels of raster and regions."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from . import raster, regions


def _otsu_or(values: np.ndarray, percentile: float) -> float:
    try:
        return raster.otsu(values)
    except ValueError:
        return float(np.percentile(values, percentile)) if values.size else 0.0


def pipeline_cell_mask(actin: np.ndarray | None, shape: tuple[int, int] = (256, 256)) -> np.ndarray:
    """M4: Otsu on bytes, strictly above, no components under 500 pixels, closed. No actin: everything."""
    if actin is None:
        return np.ones(shape, bool)
    b = raster.to_byte(actin) if actin.dtype != np.uint8 else actin
    try:
        return regions.closing(regions.remove_small(b > raster.otsu(b), 500), 5)
    except ValueError:
        return np.ones(actin.shape, bool)


class Ladder(NamedTuple):
    """Where to go if Otsu's threshold is out of bounds: percentiles in order, of which the first counts that leaves more than
    `least` pixels (if under 1, that share of them) and less than the share `most` above it; else the percentile `last`."""

    steps: tuple[int, ...]
    least: float
    most: float
    last: int


#: The ladders, sizes and radii of nuclei and of cells around them.
NUCLEI_LADDER = Ladder((80, 75, 70, 65, 60), 50, 0.5, 75)
CELL_LADDER = Ladder((50, 45, 40, 35), 0.1, 0.6, 40)
CELL_BOUNDS, FAINT, FAINT_STEP = (0.1, 0.9), 0.05, 30
SMALL_CELL, SMALL_CELL_REACH, MOST_NUCLEI = 1000, 20, 4
ANCHOR_STEP, ANCHOR_SIZE, LOOSE_STEP = 85, 100, 25


def climb(values: np.ndarray, counted: np.ndarray, bounds: tuple[float, float], ladder: Ladder, bound_steps: bool) -> float:
    """Otsu's threshold of the values if it is within bounds, else the ladder's. Pixels above a step are counted in `counted`;
    with bound_steps the step that counts has to be within bounds too, or the last percentile does."""
    low, high = bounds
    t = raster.otsu(values)
    if low <= t <= high:
        return t
    steps = np.percentile(values, ladder.steps)
    above = np.array([(counted > x).sum() for x in steps])
    least = ladder.least * values.size if ladder.least < 1 else ladder.least
    fits = np.flatnonzero((above > least) & (above < ladder.most * values.size))
    found = float(steps[fits[0]]) if fits.size else float("nan")
    return float(np.percentile(values, ladder.last)) if np.isnan(found) or (bound_steps and not low <= found <= high) else found


class Nuclei(NamedTuple):
    mask: np.ndarray
    count: int
    areas: list[int]
    warnings: list[str]
    min_area: int
    max_area: int
    threshold: float


def _doubts(areas: list[int], cell_area: float, threshold: float, lo: int, hi: int) -> list[str]:
    """What is unusual about nuclei of these areas."""
    cases = {
        f"no nuclei (threshold {threshold:.3f}, areas {lo} to {hi})": not areas,
        f"{len(areas)} nuclei, more than {MOST_NUCLEI}": len(areas) > MOST_NUCLEI,
        f"nuclei cover {sum(areas)} pixels, the cell {cell_area:.0f}": sum(areas) > cell_area,
    }
    return [text for text, true in cases.items() if true]


def nuclei(image: np.ndarray, cell: np.ndarray, cell_area: float | None = None, blur: float = 1.5, opening_radius: int = 1, least: float = 0.01, most: float = 0.25) -> Nuclei:
    """M5: denoised, thresholded within the cell, smoothed, components of 1 % to 25 % of the cell's area. Splitting touching
    nuclei is left out: the watershed of the original is undone by the union that follows it."""
    total = float(cell.sum())
    cell_area = total if cell_area is None else cell_area
    soft = raster.gaussian(raster.median(raster.by_255(image), 5), max(blur, 1.5))
    zone = cell if total >= SMALL_CELL else regions.dilate(cell, SMALL_CELL_REACH)
    zone = zone if zone.any() else np.ones(cell.shape, bool)
    t = climb(soft[zone], soft, tuple(np.percentile(soft[zone], (5, 95))), NUCLEI_LADDER, bound_steps=False)
    found = zone & (soft > t)
    for step, radius in ((regions.opening, max(opening_radius, 3)), (lambda m, _: regions.fill_holes(m), 0), (regions.opening, 2), (regions.closing, 2)):
        found = step(found, radius)
    if total > SMALL_CELL:
        found &= zone
    lo, hi = int(cell_area * least), int(cell_area * most)
    labels, n = regions.label(regions.remove_small(found, lo))
    sizes = np.bincount(labels.ravel(), minlength=n + 1)
    kept = (sizes >= lo) & (sizes <= hi) & (np.arange(n + 1) > 0)
    areas = sizes[kept].tolist()
    return Nuclei(kept[labels], len(areas), areas, _doubts(areas, cell_area, t, lo, hi), lo, hi, t)


def pick_component(found: list[regions.Region], target: tuple[float, float]) -> int | None:
    """R3, in label order: a nearer one is taken; so is one of over 500 pixels within 1.5 times the distance, which then is
    the distance to beat."""
    best, near = None, np.inf
    for r in found:
        d = float(np.sqrt((r.centroid[0] - target[0]) ** 2 + (r.centroid[1] - target[1]) ** 2))  # equal for equally far ones more often than hypot
        if d < near or (d < 1.5 * near and r.area > 500):
            best, near = r.label, d
    return best


def _anchor(image: np.ndarray) -> tuple[list[int], tuple[float, float]]:
    """The box (r0, c0, r1, c1) and the centre of the bright nuclei; without any, of the middle of the image."""
    h, w = image.shape
    soft = raster.gaussian(image, 1.5)
    lit = soft[image > 0.1]
    found = regions.of(regions.remove_small(soft > np.percentile(lit if lit.size else soft, ANCHOR_STEP), ANCHOR_SIZE))
    if not found:
        return [h // 4, w // 4, 3 * h // 4, 3 * w // 4], (h / 2, w / 2)
    corners, weights = np.array([r.bbox for r in found]), [r.area for r in found]
    y, x = np.average([r.centroid for r in found], 0, weights)
    return [*corners[:, :2].min(0).tolist(), *corners[:, 2:].max(0).tolist()], (float(y), float(x))


def nuclei_anchored_cell(actin: np.ndarray, nuclei_image: np.ndarray, margin: int = 150, blur: float = 2.5, closing_radius: int = 5, min_size: int = 500) -> np.ndarray:
    """M6: the actin component that belongs to the nuclei, looked for around them."""
    a = raster.by_255(actin)
    box, centre = _anchor(raster.by_255(nuclei_image))
    top, left = (max(0, box[k] - margin) for k in (0, 1))
    window = slice(top, min(a.shape[0], box[2] + margin)), slice(left, min(a.shape[1], box[3] + margin))
    part = raster.median(raster.gaussian(a[window], blur), 3)
    span = part.max() - part.min()
    part = (part - part.min()) / span if span > 0 else part
    t = climb(part, part, CELL_BOUNDS, CELL_LADDER, bound_steps=True)
    t = float(np.percentile(part, FAINT_STEP)) if t < FAINT else t
    dense = regions.fill_holes(regions.remove_small(regions.closing(part > t, closing_radius), max(min_size, 500)))
    loose = regions.remove_small(part > np.percentile(part, LOOSE_STEP), min_size // 2)
    labels, n = next((x for x in map(regions.label, (dense, loose)) if x[1]), (None, 0))
    out = np.zeros(a.shape, bool)
    if not n:
        return out
    out[window] = labels == pick_component(regions.regions(labels, n), (centre[0] - top, centre[1] - left))
    out = regions.closing(regions.closing(regions.opening(out, 3), 5), 3)
    return out if out.sum() >= 500 else regions.closing(regions.dilate(out, 10), 5)


def simple_cell(actin: np.ndarray, box: tuple[int, int, int, int] | None = None, blur: float = 2.0, closing_radius: int = 5, min_size: int = 500) -> np.ndarray:
    """M7: blurred, Otsu, closed, small components dropped, filled, the largest kept; within a box (r0, c0, r1, c1) if given."""
    a = raster.by_255(actin)
    r0, c0, r1, c1 = box or (0, 0, *a.shape)
    soft = raster.gaussian(a[r0:r1, c0:c1], blur)
    m = regions.fill_holes(regions.remove_small(regions.closing(soft > _otsu_or(soft, 50), closing_radius), min_size))
    labels, n = regions.label(m)
    top = regions.largest(regions.regions(labels, n))
    out = np.zeros(a.shape, bool)
    if top:
        out[r0:r1, c0:c1] = labels == top.label
    return out


def simple_nuclei(image: np.ndarray, cell: np.ndarray | None = None, blur: float = 1.5, opening_radius: int = 2, min_size: int = 100) -> np.ndarray:
    """M8: as M5 if there is a cell mask; else blurred, Otsu, opened, small components dropped."""
    if cell is not None:
        return nuclei(image, cell, None, blur, opening_radius).mask
    soft = raster.gaussian(raster.by_255(image), blur)
    return regions.remove_small(regions.opening(soft > _otsu_or(soft, 85), opening_radius), min_size)


def cytoplasm(cell: np.ndarray, nucleus: np.ndarray, radius: int = 2) -> np.ndarray:
    """M9."""
    if cell.shape != nucleus.shape:
        raise ValueError(f"masks of different shapes: {cell.shape}, {nucleus.shape}")
    return cell & ~regions.erode(nucleus, radius)


class Thresholds(NamedTuple):
    edge_density_min: float = 0.01
    nucleus_area_min: float = 500
    nucleus_area_max: float = 8000
    cell_area_min: float = 5000
    cell_area_max: float = 50000


#: The second, wider limits.
RELAXED = Thresholds(0.005, 300, 45000, 3000, 65500)


def edge_density(gray: np.ndarray) -> float:
    """A18."""
    m = raster.sobel_magnitude(gray)
    return float((m > np.percentile(m, 90)).mean())


def qc_nucleus(channel: np.ndarray) -> tuple[float, int]:
    """Q1: the largest component's area and the number of components; (0, 0) for none or one over 80 % of the image."""
    m = channel > _otsu_or(channel, 80)
    if not m.any():
        m = channel > np.percentile(channel, 60)
    return _qc(regions.remove_small(regions.opening(regions.closing(m, 3), 2), 100), 0.8)


def qc_cell(mt: np.ndarray, actin: np.ndarray) -> tuple[float, int]:
    """Q2: likewise for tubules or actin; none over 98 %."""

    def one(channel: np.ndarray) -> np.ndarray:
        m = channel > _otsu_or(channel, 60)
        return m if m.any() else channel > np.percentile(channel, 40)

    return _qc(regions.remove_small(regions.opening(regions.closing(one(mt) | one(actin), 5), 3), 500), 0.98)


def _qc(m: np.ndarray, most: float) -> tuple[float, int]:
    labels, n = regions.label(m)
    if not n:
        return 0.0, 0
    top = int(np.bincount(labels.ravel())[1:].max())
    return (0.0, 0) if top > most * m.size else (float(top), n)


class Score(NamedTuple):
    passes: bool
    edge_density: float
    nucleus_area: float
    nucleus_num_components: int
    cell_area: float
    cell_num_components: int
    reasons: list[str]


def measure(rgb: np.ndarray) -> tuple[float, float, int, float, int]:
    """What the limits are held against."""
    if rgb.ndim != 3 or rgb.shape[2] < 3:
        raise ValueError(f"an RGB image is needed, not {rgb.shape}")
    x = raster.by_255(rgb)
    return (edge_density(raster.luminance(x)), *qc_nucleus(x[..., 2]), *qc_cell(x[..., 0], x[..., 1]))


def score(measured: tuple[float, float, int, float, int], t: Thresholds = Thresholds()) -> Score:
    """Q3: weak signals count: no nucleus passes if edges and cell do, then no cell if edges and nucleus do."""
    edge, n_area, n_parts, c_area, c_parts = measured
    edge_ok = edge >= t.edge_density_min
    nucleus_ok = 1 <= n_parts <= 15 and t.nucleus_area_min <= n_area <= t.nucleus_area_max
    cell_ok = 1 <= c_parts <= 5 and t.cell_area_min <= c_area <= t.cell_area_max
    if n_parts == 0 and edge_ok and cell_ok:
        nucleus_ok = True
    if c_parts == 0 and edge_ok and nucleus_ok:
        cell_ok = True
    reasons = [] if edge_ok else [f"low edge density: {edge:.4f} < {t.edge_density_min}"]
    for name, ok, parts, size, most, lo, hi in (("nucleus", nucleus_ok, n_parts, n_area, 15, t.nucleus_area_min, t.nucleus_area_max), ("cell", cell_ok, c_parts, c_area, 5, t.cell_area_min, t.cell_area_max)):
        if not ok:
            reasons.append(f"no {name}" if parts == 0 else f"{name} too fragmented: {parts} components" if parts > most else f"{name} too small: {size:.0f} < {lo:.0f}" if size < lo else f"{name} too large: {size:.0f} > {hi:.0f}")
    return Score(edge_ok and nucleus_ok and cell_ok, edge, n_area, n_parts, c_area, c_parts, reasons)


class Prompts(NamedTuple):
    box: tuple[int, int, int, int]
    points: list[tuple[int, int]]
    labels: list[int]
    rough_nuclei: np.ndarray | None


def prompts(image: np.ndarray, nuclei_image: np.ndarray | None, seed: int = 0, box_margin: int = 100, num_points: int = 5) -> Prompts:
    """A box (x0, y0, x1, y1) and points (x, y) around the nuclei, else the brightest fifth, else the centre; filled up to
    num_points at random, and three on the image's edge as negatives."""
    rng = np.random.default_rng(seed)
    g = raster.by_255(raster.gray(image))
    h, w = g.shape
    box, inside, rough = None, [], None
    if nuclei_image is not None:
        nu = raster.by_255(raster.resize(raster.gray(nuclei_image).astype(float), (h, w)))
        soft = raster.median(nu, 3)
        labels, n = regions.label(regions.remove_small(soft > _otsu_or(soft, 85), 200))
        found = regions.regions(labels, n)
        if top := regions.largest(found):
            rough = labels == top.label
            my, mx = min(int(0.25 * h), 200), min(int(0.25 * w), 200)
            r0, c0, r1, c1 = max(0, top.bbox[0] - my), max(0, top.bbox[1] - mx), min(h, top.bbox[2] + my), min(w, top.bbox[3] + mx)
            box = (c0, r0, c1, r1)
            centres = [(int(r.centroid[0]), int(r.centroid[1])) for r in found]
            inside = [(y, x) for y, x in centres if r0 <= y < r1 and c0 <= x < c1]
    if box is None:
        bright = g > np.percentile(g, 80)
        if top := regions.largest(regions.of(bright)):
            r0, c0, r1, c1 = max(0, top.bbox[0] - box_margin), max(0, top.bbox[1] - box_margin), min(h, top.bbox[2] + box_margin), min(w, top.bbox[3] + box_margin)
            box = (c0, r0, c1, r1)
            on = np.argwhere(bright[r0:r1, c0:c1])
            inside = [(int(y) + r0, int(x) + c0) for y, x in rng.permutation(on)[:num_points]]
    if box is None:
        y, x = h // 2, w // 2
        box, inside = (max(0, x - box_margin), max(0, y - box_margin), min(w, x + box_margin), min(h, y + box_margin)), [(y, x)]
    while len(inside) < num_points:
        inside.append((int(rng.integers(box[1], box[3])), int(rng.integers(box[0], box[2]))))
    outside = [(int(rng.choice([0, h - 1])), int(rng.integers(w))) if rng.random() < 0.5 else (int(rng.integers(h)), int(rng.choice([0, w - 1]))) for _ in range(3)]
    return Prompts(box, [(x, y) for y, x in inside + outside], [1] * len(inside) + [0] * 3, rough)


def candidate_score(iou: float, above_background: float, nuclei_overlap: float, mask_area: float, pixels: float) -> float:
    """How good a candidate mask is."""
    return 0.4 * iou + 0.3 * min(2 * above_background, 1) + 0.2 * nuclei_overlap + 0.1 * min(mask_area / (0.3 * pixels), 1)


def border_background(g: np.ndarray) -> float:
    """The median of the four edges; corners count twice."""
    return float(np.median(np.concatenate([g[0], g[-1], g[:, 0], g[:, -1]])))


def choose_mask(candidates: list[np.ndarray], ious: list[float], image: np.ndarray, nuclei_mask: np.ndarray | None, min_area: int = 500) -> np.ndarray | None:
    """The best candidate of at least min_area pixels and at most 90 %; else the one of the highest iou."""
    if not candidates:
        return None
    g = raster.by_255(raster.gray(image))
    background = border_background(g)
    best, most = None, -1.0
    for m, q in zip(candidates, ious, strict=True):
        if min_area <= m.sum() <= 0.9 * m.size:
            overlap = (m & nuclei_mask).sum() / nuclei_mask.sum() if nuclei_mask is not None and nuclei_mask.any() else 0.0
            s = candidate_score(q, float(g[m].mean() - background), float(overlap), float(m.sum()), m.size)
            if s > most:
                best, most = m, s
    return candidates[int(np.argmax(ious))] if best is None else best


def refine_mask(m: np.ndarray, image: np.ndarray, rough_nuclei: np.ndarray | None, min_area: int = 500) -> np.ndarray:
    """X16's end (J7, F16): the component over the nuclei, smoothed, widened, its dark third cut, and bands at the top and
    bottom cleared where it covers over 40 % of them."""
    m = regions.remove_small(m, min_area)
    if rough_nuclei is not None and rough_nuclei.any():
        labels, n = regions.label(m)
        if n:
            m = labels == 1 + int(np.argmax(np.bincount(labels[rough_nuclei], minlength=n + 1)[1:]))
    m = regions.dilate(regions.fill_holes(regions.opening(regions.closing(m, 5), 3)), 10)
    g = raster.by_255(raster.gray(image))
    if m.any():
        m &= g > np.percentile(g[m], 30)
    m = regions.fill_holes(m)
    if band := int(0.03 * m.shape[0]):
        for rows in (slice(0, band), slice(-band, None)):
            if m[rows].mean() > 0.4:
                m[rows] = False
    return m


def seed_points(m: np.ndarray, n: int = 5, seed: int = 0) -> list[tuple[int, int]]:
    """(x, y) of the largest component's centroid and of other pixels of the mask, without repeats."""
    top = regions.largest(regions.of(m))
    if top is None:
        return []
    on = np.random.default_rng(seed).permutation(np.argwhere(m))[: max(0, n - 1)]
    return [(int(top.centroid[1]), int(top.centroid[0])), *((int(x), int(y)) for y, x in on)]


def segment_cell(image: np.ndarray, nuclei_image: np.ndarray | None, predict, seed: int = 0, min_area: int = 500) -> np.ndarray:
    """Prompts, a model's candidate masks, the best of them, refined. predict: (image, points (x, y), labels, box) to
    (masks, ious)."""
    p = prompts(image, nuclei_image, seed)
    candidates, ious = predict(image, np.array(p.points), np.array(p.labels), p.box)
    nuclei_mask = None
    if nuclei_image is not None:
        soft = raster.gaussian(raster.by_255(raster.resize(raster.gray(nuclei_image).astype(float), image.shape[:2])), 1.5)
        nuclei_mask = regions.remove_small(soft > np.percentile(soft, 85), 50)
    best = choose_mask([m.astype(bool) for m in candidates], list(ious), image, nuclei_mask, min_area)
    return np.zeros(image.shape[:2], bool) if best is None else refine_mask(best.copy(), image, p.rough_nuclei, min_area)


def refine_with(image: np.ndarray, initial: np.ndarray, predict, points: list[tuple[int, int]] | None = None) -> np.ndarray:
    """The model's best mask for points of an initial mask; the initial mask itself if anything fails."""
    try:
        at = points or seed_points(initial)
        candidates, ious = predict(image, np.array(at), np.ones(len(at), int), None)
        return candidates[int(np.argmax(ious))].astype(bool)
    except Exception:  # the mask at hand is the answer then
        return initial
