"""Operators on tiles against the same ones on whole rasters, and suppression by grids against going through the boxes."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from spectraframe.functions import masks, raster, regions
from spectraframe.operators import graph, suppression, tiles
from spectraframe.schemas import RASTER
from spectraframe.sources.rasters import pack, unpack


def table(spark, arrays):
    return spark.createDataFrame([(k, pack(a)) for k, a in enumerate(arrays)], f"image_id long, image {RASTER.simpleString()}")


def images_of(df):
    return {r.image_id: unpack(r.image.asDict()) for r in tiles.joined(df).collect()}


SHAPES = [(1, 1), (5, 17), (16, 16), (33, 20), (7, 40)]


@pytest.fixture(scope="module")
def grays():
    rng = np.random.default_rng(1)
    return [rng.random(s) for s in SHAPES]


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(2)
    return [rng.random(s) < 0.55 for s in SHAPES] + [np.zeros((9, 9), bool), np.ones((12, 13), bool)]


def test_cut_and_joined(spark, grays):
    got = images_of(tiles.cut(table(spark, grays), 8))
    assert all((got[k] == a).all() for k, a in enumerate(grays))


@pytest.mark.parametrize(("kernel", "radius", "mode"), [(raster.sobel_magnitude, 1, "reflect"), (lambda a: raster.median(a, 3), 3, "nearest")])
def test_stencils(spark, grays, kernel, radius, mode):
    some = [a for a in grays if min(a.shape) > radius]
    got = images_of(tiles.stencil(tiles.cut(table(spark, some), 8), kernel, radius, 8, mode))
    for k, a in enumerate(some):
        np.testing.assert_allclose(got[k], kernel(a), atol=1e-12)


def test_a_radius_beyond_a_tile(spark, grays):
    some = [a for a in grays if min(a.shape) > 8]
    got = images_of(tiles.stencil(tiles.cut(table(spark, some), 4), lambda a: raster.gaussian(a, 2), 8, 4))
    for k, a in enumerate(some):
        np.testing.assert_allclose(got[k], raster.gaussian(a, 2), atol=1e-12)


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components(spark, blobs, connectivity):
    found = tiles.Labelled(tiles.cut(table(spark, blobs), 8), 8, connectivity)
    got = {}
    for r in found.components().collect():
        got.setdefault(r.image_id, {})[r.label] = r
    for k, a in enumerate(blobs):
        labels, n = regions.label(a, connectivity)
        want = regions.regions(labels, n)
        assert len(got.get(k, {})) == n
        for w in want:
            r = got[k][w.label]
            assert (r.area, (r.r0, r.c0, r.r1, r.c1)) == (w.area, w.bbox)
            np.testing.assert_allclose([r.cy, r.cx, r.major, r.minor], [*w.centroid, w.major, w.minor], atol=1e-6)
            if connectivity == 8:
                assert abs(r.perimeter - w.perimeter) < 1e-6
            assert r.edge == (w.bbox[0] == 0 or w.bbox[1] == 0 or w.bbox[2] == a.shape[0] or w.bbox[3] == a.shape[1])


def test_masks_of_components(spark, blobs):
    cut = tiles.cut(table(spark, blobs), 8)
    filled, large, small = images_of(tiles.fill_holes(cut, 8)), images_of(tiles.largest(cut, 8)), images_of(tiles.remove_small(cut, 8, 6))
    for k, a in enumerate(blobs):
        assert (filled[k] == regions.fill_holes(a)).all()
        assert (small[k] == regions.remove_small(a, 6)).all()
        labels, n = regions.label(a)
        first = regions.largest(regions.regions(labels, n))
        assert (large[k] == (labels == first.label if first else np.zeros_like(a))).all()


def test_one_large_raster_in_many_tasks(spark):
    rng = np.random.default_rng(4)
    a = np.kron(rng.random((128, 128)) < 0.5, np.ones((8, 8), bool)) ^ (rng.random((1024, 1024)) < 0.001)
    found = tiles.Labelled(tiles.cut(table(spark, [a]), 128), 128)
    assert found.tiles.count() == 64
    labels, n = regions.label(a)
    areas = np.bincount(labels.ravel())[1:]
    assert [r.area for r in found.components().orderBy("label").select("area").collect()] == areas.tolist()


def test_graph(spark):
    rng = np.random.default_rng(5)
    edges = [(g, int(u), int(v)) for g in (1, 2) for u, v in rng.integers(0, 400, (230, 2))] + [(3, k, k + 1) for k in range(300)] + [(4, 0, k) for k in range(1, 300)]
    got = {(r.group, r.node): r.root for r in graph.components(spark.createDataFrame(edges, "group long, u long, v long")).collect()}
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for g, u, v in edges:
        a, b = sorted([root((g, u)), root((g, v))])
        up[b] = a
    assert got == {x: root(x)[1] for x in up if root(x) != x}


def boxes(seed, n, size, where):
    rng = np.random.default_rng(seed)
    at = rng.random((n, 2)) * where
    wh = size * 2 ** rng.uniform(-2, 2, (n, 2))
    return [(k, *map(float, (*a, *(a + s))), float(v)) for k, (a, s, v) in enumerate(zip(at, wh, rng.integers(0, n // 3 + 1, n), strict=True))]


def boxed(spark, rows):
    df = spark.createDataFrame([(str(i), *r) for i, rs in enumerate(rows) for r in rs], "image_id string, id long, x0 double, y0 double, x1 double, y1 double, score double")
    return df.select("image_id", "id", F.struct("x0", "y0", "x1", "y1").alias("box"), "score")


@pytest.mark.parametrize("threshold", [0.0, 0.5, 1.0])
def test_suppression_by_grids(spark, threshold):
    rows = [boxes(1, 150, 10, 60), boxes(2, 60, 3, 4), [(0, 1.0, 1.0, 1.0, 5.0, 3.0), (1, 0.0, 0.0, 9.0, 9.0, 1.0), (2, 0.0, 0.0, 9.0, 9.0, 1.0), (3, -5.0, -5.0, 4.0, 4.0, 2.0)]]
    got = {(r.image_id, r.id) for r in suppression.suppressed(boxed(spark, rows), threshold, small=0).collect()}
    want = {(str(i), rs[k][0]) for i, rs in enumerate(rows) for k in masks.nms(np.array([r[1:5] for r in rs]), np.array([r[5] for r in rs]), threshold)}
    assert got == want


def test_suppression_of_a_large_image(spark):
    """One image of many boxes, by grids; a small one beside it, in a task."""
    n = 20_000
    x, y = (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(30_000)) / 10.0 for k in (1, 2))
    many = spark.range(n).select(F.lit("many").alias("image_id"), "id", F.struct(x.alias("x0"), y.alias("y0"), (x + 100).alias("x1"), (y + 100).alias("y1")).alias("box"), (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1000)) / 1000.0).alias("score"))
    few = boxed(spark, [boxes(5, 40, 10, 30)])
    kept = suppression.suppressed(many.unionByName(few), 0.5).persist()
    at = many.toPandas()
    order = at.sort_values(["score", "id"], ascending=[False, True])
    got = {r.id for r in kept.where("image_id = 'many'").select("id").collect()}
    assert 0 < len(got) < n
    best = np.array([[b[k] for k in ("x0", "y0", "x1", "y1")] for b in order["box"]])
    ids, chosen = order["id"].to_numpy(), []
    alive = np.ones(n, bool)
    while alive.any():  # one by one, on bare arrays
        k = int(np.argmax(alive))
        chosen.append(int(ids[k]))
        near = alive & (np.abs(best[:, 0] - best[k, 0]) < 100) & (np.abs(best[:, 1] - best[k, 1]) < 100)
        some = np.flatnonzero(near)
        alive[some[masks.iou(best[k : k + 1], best[some])[0] > 0.5]] = False
        alive[k] = False
    assert got == set(chosen)
    kept.unpersist()
