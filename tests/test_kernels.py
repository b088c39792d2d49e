"""Kernels against hand-made cases and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from spectraframe.functions import masks, png, raster, regions, segment, texture
from spectraframe.operators.clustering import cut, ward_linkage

RING = np.array([[0, 0, 0, 0, 0], [0, 1, 1, 1, 0], [0, 1, 0, 1, 0], [0, 1, 1, 1, 0], [0, 0, 0, 0, 0]], bool)
mask_arrays = st.integers(1, 9).flatmap(lambda h: st.integers(1, 9).flatmap(lambda w: st.lists(st.booleans(), min_size=h * w, max_size=h * w).map(lambda v: np.array(v).reshape(h, w))))


def flood(mask, connectivity):
    """Components by flood filling, in the order of first pixels."""
    out, n = np.zeros(mask.shape, int), 0
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 8 else [])
    for start in np.argwhere(mask):
        if out[tuple(start)]:
            continue
        n += 1
        todo = [tuple(start)]
        while todo:
            r, c = todo.pop()
            if 0 <= r < mask.shape[0] and 0 <= c < mask.shape[1] and mask[r, c] and not out[r, c]:
                out[r, c] = n
                todo += [(r + a, c + b) for a, b in near]
    return out, n


@settings(max_examples=150, deadline=None)
@given(mask_arrays, st.sampled_from([4, 8]))
def test_labels(mask, connectivity):
    got, n = regions.label(mask, connectivity)
    want, m = flood(mask, connectivity)
    assert n == m
    assert (got == want).all()


def test_ring():
    assert (regions.fill_holes(RING) == (RING | (np.indices((5, 5)) == 2).all(0))).all()
    (r,) = regions.of(RING)
    assert (r.area, r.bbox, r.centroid) == (8, (1, 1, 4, 4), (2.0, 2.0))
    assert regions.of(np.eye(2, dtype=bool))[0].area == 2
    assert len(regions.regions(*regions.label(np.eye(2, dtype=bool), 4))) == 2


def test_perimeter_of_a_square():
    square = np.zeros((12, 12), bool)
    square[2:10, 2:10] = True
    assert regions.perimeter(square) == pytest.approx(28)
    (r,) = regions.of(square)
    assert r.major == pytest.approx(r.minor) == pytest.approx(4 * np.sqrt((8**2 - 1) / 12 + 1 / 12))


@settings(max_examples=100, deadline=None)
@given(mask_arrays, st.integers(0, 3))
def test_morphology(mask, radius):
    want = np.zeros_like(mask)
    for y, x in raster.disk(radius):
        shifted = np.zeros_like(mask)
        h, w = mask.shape
        if abs(y) < h and abs(x) < w:
            shifted[max(0, y) : h + min(0, y), max(0, x) : w + min(0, x)] = mask[max(0, -y) : h + min(0, -y), max(0, -x) : w + min(0, -x)]
        want |= shifted
    assert (regions.dilate(mask, radius) == want).all()
    assert (regions.erode(mask, radius) == ~regions.dilate(~mask, radius)).all()
    closed = regions.closing(mask, radius)
    assert (regions.closing(closed, radius) == closed).all()


@settings(max_examples=100, deadline=None)
@given(mask_arrays)
def test_run_lengths(mask):
    counts = masks.encode(mask)
    assert (masks.decode(mask.shape, counts) == mask).all()
    assert masks.area(counts) == mask.sum()
    assert sum(counts) == mask.size
    assert len(masks.coco_string(counts)) >= len(counts)


def test_coco_string():
    assert masks.coco_string([0, 1, 2]) == "012"
    assert masks.coco_string([40]) == "X1"


def test_boxes_and_suppression():
    assert masks.box(np.zeros((4, 4), bool)) == [0, 0, 0, 0]
    assert masks.box(RING) == [1, 1, 3, 3]
    boxes = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [20, 20, 30, 30]])
    assert masks.nms(boxes, np.array([0.5, 0.9, 0.1]), 0.5) == [1, 2]
    assert masks.near_crop_edge(np.array([[0, 30, 40, 60]]), [100, 0, 200, 100], [0, 0, 400, 100]).tolist() == [True]
    assert masks.near_crop_edge(np.array([[0, 30, 40, 60]]), [0, 0, 200, 100], [0, 0, 400, 100]).tolist() == [False]
    assert len(masks.crop_boxes((240, 320), 2, 0.34)) == 1 + 4 + 16
    assert masks.longest_side(100, 50, 64) == (64, 32)
    assert masks.choose_single(np.array([0.1, 0.9, 0.5, 0.2]), 1) == 1
    assert masks.choose_single(np.array([0.1, 0.9, 0.5, 0.2]), 5) == 0


def test_small_regions():
    assert regions.remove_small_regions(RING, 2, "holes")[0].sum() == 9
    assert regions.remove_small_regions(RING, 1, "holes")[1] is False
    two = np.zeros((5, 9), bool)
    two[1, 1], two[1:4, 4:8] = True, True
    assert regions.remove_small_regions(two, 3, "islands")[0].sum() == 12
    assert regions.remove_small_regions(two, 99, "islands")[0].sum() == 12
    with pytest.raises(ValueError):
        regions.remove_small_regions(two, 1, "both")


@pytest.mark.parametrize("shape", [(5, 7), (5, 7, 3), (5, 7, 4)])
@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_png(shape, dtype):
    a = np.random.default_rng(0).integers(0, np.iinfo(dtype).max, shape).astype(dtype)
    assert (png.decode(png.encode(a)) == a).all()


@pytest.mark.parametrize("method", [1, 2, 3, 4])
def test_png_filters(method):
    """Rows written with each filter by hand decode to the same image."""
    import struct
    import zlib

    a = np.random.default_rng(method).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    flat, body = a.reshape(6, 15).astype(int), b""
    for y in range(6):
        line = [method]
        for k in range(15):
            left, up = flat[y, k - 3] if k >= 3 else 0, flat[y - 1, k] if y else 0
            corner = flat[y - 1, k - 3] if y and k >= 3 else 0
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            line.append((flat[y, k] - [0, left, up, (left + up) // 2, paeth][method]) % 256)
        body += bytes(int(x) for x in line)
    out = png.SIGNATURE
    for name, data in ((b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(body)), (b"IEND", b"")):
        out += struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    assert (png.decode(out) == a).all()


def test_intensity_rules():
    assert raster.to_float(np.array([[0, 255]], np.uint8)).tolist() == [[0, 1]]
    assert raster.to_float(np.array([[0, 4.0]])).tolist() == [[0, 1]]
    assert raster.to_byte(np.array([0.999, 1.2, -1])).tolist() == [254, 255, 0]
    assert (raster.stretch(np.ones((4, 4))) == 0).all()
    a = np.full((4, 4), 200, np.uint8)
    assert (raster.resize(a, (8, 8)) == 200).all()
    assert raster.resize(a, (4, 4)) is a


def test_filters():
    step = np.zeros((9, 9))
    step[:, 5:] = 1
    h, v = raster.sobel(step)
    assert np.allclose(h, 0)
    assert v[4, 4] == pytest.approx(0.5)
    assert raster.gaussian(np.ones((6, 6)), 2) == pytest.approx(np.ones((6, 6)))
    assert raster.median(step, 1)[4, 4] == 0
    assert raster.otsu(np.array([0, 0, 1, 9, 10, 10], np.uint8)) in range(1, 9)
    assert raster.otsu(np.full(5, 3.0)) == 3
    assert segment.edge_density(np.ones((20, 20))) == 0


def test_warps_keep_a_flat_image():
    rng = np.random.default_rng(1)
    a = np.full((64, 64), 0.5)
    for b in (raster.rotate(a, 10), raster.zoom(a, 0.9), raster.elastic(a, rng), raster.thin_plate_warp(a, *raster.control_points(a.shape, rng))):
        assert np.allclose(b, 0.5)
    x = rng.random((16, 16))
    assert np.allclose(raster.rotate(x, 0), x)
    assert np.allclose(raster.zoom(x, 1), x)
    assert (raster.flip(raster.flip(x, True, True), True, True) == x).all()
    assert np.allclose(raster.thin_plate_warp(x, p := np.array([(4.0, 4.0), (9.0, 3.0)]), p), x, atol=1e-6)


def test_features_of_empty_and_full_masks():
    image, none, every = np.random.default_rng(2).random((32, 32)), np.zeros((32, 32), bool), np.ones((32, 32), bool)
    f = texture.all_features(image, image, image, none, none, none)
    assert tuple(f) == texture.FEATURES
    assert len(f) == 24
    assert (f["glcm_homogeneity"], f["glcm_smoothness"], f["circularity"], f["aspect_ratio"], f["nc_ratio"]) == (1, 1, 0, 1, 0)
    f = texture.all_features(image, image, image, every, none, every)
    assert f["cell_area"] == 1024
    assert 0 <= f["alignment_index"] <= 1
    assert 0 <= f["actin_anisotropy"] <= 1
    assert texture.all_features(None, None, None, every, none, every)["glcm_contrast"] == 0


def test_quality_overrides():
    t = segment.Thresholds()
    assert segment.score((0.1, 1000, 2, 10000, 1), t).passes
    assert segment.score((0.1, 0, 0, 10000, 1), t).passes
    assert segment.score((0.1, 1000, 2, 0, 0), t).passes
    assert not segment.score((0.1, 0, 0, 0, 0), t).passes
    assert "fragmented" in segment.score((0.1, 1000, 16, 10000, 6), t).reasons[0]
    assert not segment.score((0.0, 1000, 2, 10000, 1), t).passes
    assert segment.score((0.006, 400, 2, 4000, 1), segment.RELAXED).passes
    with pytest.raises(ValueError):
        segment.measure(np.zeros((4, 4)))


def test_component_fold_takes_a_larger_distance():
    def r(label, y, area):
        return regions.Region(label, area, (0, 0, 1, 1), (y, 0.0), 1, 1, 1)

    assert segment.pick_component([r(1, 10, 100), r(2, 14, 501), r(3, 20, 501)], (0, 0)) == 3
    assert segment.pick_component([r(1, 10, 100), r(2, 14, 500)], (0, 0)) == 1
    assert segment.pick_component([], (0, 0)) is None


def test_cytoplasm_shapes():
    with pytest.raises(ValueError):
        segment.cytoplasm(np.ones((3, 3), bool), np.ones((4, 4), bool))


def test_ward_finds_separate_groups():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.1, (10, 2)) for c in (0, 5, 10)])
    labels = cut(ward_linkage(x), 30, 3)
    assert [len(set(labels[k : k + 10].tolist())) for k in (0, 10, 20)] == [1, 1, 1]
    assert len(set(labels.tolist())) == 3


def test_prompts_and_choice():
    image = np.zeros((80, 80))
    image[20:60, 20:60] = 1
    nuclei = np.zeros((80, 80))
    nuclei[30:50, 30:50] = 1
    p = segment.prompts(image, nuclei)
    assert len(p.points) == 8
    assert p.labels == [1] * 5 + [0] * 3
    assert p.box == (10, 10, 70, 70)
    good, bad = image > 0, np.ones((80, 80), bool)
    assert (segment.choose_mask([bad, good], [0.9, 0.5], image, p.rough_nuclei) == good).all()
    assert segment.refine_mask(good, image, p.rough_nuclei).any()
    assert segment.seed_points(np.zeros((3, 3), bool)) == []


def test_batches_and_logits():
    assert masks.batches(2, [1, 2, 3], "abc") == [([1, 2], "ab"), ([3], "c")]
    with pytest.raises(ValueError):
        masks.batches(2, [1], [1, 2])
    up = masks.restore_logits(np.ones((2, 4, 4)), 16, (16, 8), (32, 16))
    assert up.shape == (2, 32, 16)
    assert np.allclose(up, 1)


def test_cell_from_prompts():
    image, nuclei = np.zeros((90, 90)), np.zeros((90, 90))
    image[20:70, 20:70], nuclei[35:55, 35:55] = 1, 1

    def predict(image, points, labels, box):
        return np.stack([image > 0, np.ones(image.shape, bool)]), np.array([0.7, 0.9])

    cell = segment.segment_cell(image, nuclei, predict)
    assert cell[45, 45]
    assert cell.sum() > 1000
    assert (segment.refine_with(image, image > 0, predict) == 1).all()
    assert (segment.refine_with(image, image > 0, None) == (image > 0)).all()


def cell_image(seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:140, :140]
    cell, nucleus = (y - 70) ** 2 + (x - 70) ** 2 < 50**2, (y - 65) ** 2 + (x - 72) ** 2 < 14**2
    return cell, nucleus, np.clip(0.7 * cell + rng.normal(0, 0.02, cell.shape), 0, 1), np.clip(0.8 * nucleus + rng.normal(0, 0.02, cell.shape), 0, 1)


def overlap(a, b):
    return (a & b).sum() / (a | b).sum()


def test_segmentation_finds_drawn_shapes():
    cell, nucleus, actin, nuc = cell_image()
    found = segment.pipeline_cell_mask(actin)
    assert overlap(found, cell) > 0.9
    n = segment.nuclei(nuc, found)
    assert n.count == 1
    assert overlap(n.mask, nucleus) > 0.8
    assert n.warnings == []
    assert overlap(segment.nuclei_anchored_cell(actin, nuc), cell) > 0.85
    assert overlap(segment.simple_cell(actin), cell) > 0.9
    assert overlap(segment.simple_cell(actin, (10, 10, 130, 130)), cell) > 0.9
    assert overlap(segment.simple_nuclei(nuc), nucleus) > 0.8
    assert overlap(segment.simple_nuclei(nuc, found), nucleus) > 0.8
    assert (segment.cytoplasm(found, n.mask) <= found).all()
    assert segment.pipeline_cell_mask(None, (5, 6)).sum() == 30


def test_no_nuclei_is_a_warning():
    cell = np.ones((60, 60), bool)
    n = segment.nuclei(np.zeros((60, 60)), cell)
    assert n.count == 0
    assert "no nuclei" in n.warnings[0]


def test_features_of_a_drawn_cell():
    cell, nucleus, actin, _ = cell_image()
    f = texture.all_features(actin, actin, actin, cell, nucleus, segment.cytoplasm(cell, nucleus))
    assert f["cell_area"] == cell.sum()
    assert f["circularity"] == pytest.approx(1, abs=0.12)
    assert f["aspect_ratio"] == pytest.approx(1, abs=0.02)
    assert f["nuclear_count"] == 1
    assert f["nc_ratio"] == pytest.approx(nucleus.sum() / (cell.sum() - nucleus.sum()))
    assert f["nucleus_polarity"] == pytest.approx(np.hypot(5, 2), abs=0.2)
