"""Tests of the review's findings."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from spectraframe.functions import raster, regions, segment
from spectraframe.operators import clustering, components, evaluate, maskops, tiles
from spectraframe.plans import kernel_queries, queries
from spectraframe.schemas import RASTER
from spectraframe.sources.images import all_images, few, write_images
from spectraframe.sources.rasters import pack

from .conftest import rows_of


def vectors(spark, x):
    return spark.createDataFrame([(7 * k, a.tolist()) for k, a in enumerate(x)], "id long, px array<double>").repartition(3)


def test_ward_of_more_rows_than_one_place_takes(spark, monkeypatch):
    x = np.random.default_rng(0).normal(size=(60, 3))
    want, merges = clustering.ward(vectors(spark, x), 4)
    want, merges = sorted(map(tuple, want.collect())), sorted(map(tuple, merges.collect()))
    monkeypatch.setattr(clustering, "MOST_WARD", 10)
    monkeypatch.setattr(clustering, "FEW_CLUSTERS", 25)
    found, rounds = clustering.ward(vectors(spark, x), 4)
    assert sorted(map(tuple, found.collect())) == want
    for a, b in zip(sorted(map(tuple, rounds.collect())), merges, strict=True):
        assert a[:3] == b[:3] and a[4] == b[4] and abs(a[3] - b[3]) < 1e-9


def test_ward_in_blocks_and_in_one_task(spark, monkeypatch):
    """Each round was some ten jobs, whatever few merges it made, and each block searched in Python for each cluster."""
    x = np.random.default_rng(5).normal(size=(150, 3))
    x[40:80] = x[0] + 0.01 * x[40:80]
    rows = spark.createDataFrame([(7 * k - 500, a.tolist()) for k, a in enumerate(x)], "id long, px array<double>").repartition(3)  # ids below 0 too
    want, merges = (sorted(map(tuple, t.collect())) for t in clustering.ward(rows, 4))
    searches, nearest = [], clustering._nearest_clusters
    monkeypatch.setattr(clustering, "_nearest_clusters", lambda some, clusters: (searches.append(some is None), nearest(some, clusters))[1])
    monkeypatch.setattr(clustering, "FEW_CLUSTERS", 25)
    monkeypatch.setattr(clustering, "WARD_BLOCK", 40)
    for task, rounds in ((60, None), (1000, 1)):  # some rounds are distributed, or the first
        searches.clear()
        monkeypatch.setattr(clustering, "TASK_CLUSTERS", task)
        labels, found = clustering.ward(rows, 4)
        assert sorted(map(tuple, labels.collect())) == want
        for a, b in zip(sorted(map(tuple, found.collect())), merges, strict=True):
            assert a[:3] == b[:3] and a[4] == b[4] and abs(a[3] - b[3]) < 1e-9
        assert searches[0] and not any(searches[1:]) and (len(searches) == rounds if rounds else len(searches) > 1)
    assert clustering.ward(rows, None)[0] is None


@pytest.mark.parametrize("kind", ["normal", "lattice", "near", "large", "small"])
def test_nearest_clusters_are_those_of_all_pairs(monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 0 if kind == "lattice" else 9) * {"large": 1e60, "small": 1e-60}.get(kind, 1)
    if kind == "near":
        x = 1e3 + 1e-4 * x
    n, ids = rng.integers(1, 1 if kind == "near" else 4, 300, endpoint=True), rng.permutation(300) - 150
    monkeypatch.setattr(clustering, "WARD_TILE", (32, 50))
    monkeypatch.setattr(clustering, "WARD_PAIRS", 64)
    cut = np.arange(300) < 180
    parts = [clustering._Side(ids[p], n[p], x[p]) for p in (cut, ~cut)]
    clustering._meet(*parts, True)
    clustering._meet(parts[0], clustering._Side(ids[cut], n[cut], x[cut]), False)
    clustering._meet(parts[1], clustering._Side(ids[~cut], n[~cut], x[~cut]), False)
    d2 = 2 * n[:, None] * n[None] / (n[:, None] + n[None]) * ((x[:, None] - x[None]) ** 2).sum(-1)
    for side, p in zip(parts, (cut, ~cut), strict=True):
        for k, i in enumerate(np.flatnonzero(p)):
            want = min((d2[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for j in range(300) if j != i)
            assert (side.d2[k], side.lo[k], side.hi[k]) == want


def test_linkage_keeps_each_rows_nearest():
    """Each merge looked through the whole matrix: the merges are those of a plain version, ties too."""
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(60, 3)), rng.integers(0, 3, (60, 3)).astype(float)):
        d = ((x[:, None] - x[None]) ** 2).sum(-1)
        np.fill_diagonal(d, np.inf)
        size, name, live = np.ones(60), list(range(60)), np.ones(60, bool)
        for step, row in enumerate(clustering.ward_linkage(x)):
            i, j = sorted(divmod(int(np.argmin(d)), 60))
            assert row.tolist() == [*sorted((name[i], name[j])), np.sqrt(d[i, j]), size[i] + size[j]]
            others = live.copy()
            others[[i, j]] = False
            t = size[i] + size[j] + size[others]
            d[i, others] = d[others, i] = ((size[i] + size[others]) * d[i, others] + (size[j] + size[others]) * d[j, others] - size[others] * d[i, j]) / t
            d[j, :] = d[:, j] = np.inf
            size[i] += size[j]
            name[i], live[j] = 60 + step, False


def test_ward_merges_many_copies_first(spark, monkeypatch):
    x = np.repeat(np.arange(30.0)[:, None] ** 2, [20] * 2 + [1] * 28, 0)
    monkeypatch.setattr(clustering, "FEW_CLUSTERS", 25)
    found, merges = clustering.ward(vectors(spark, x), 2)
    distances = [r.distance for r in merges.orderBy("step").collect()]
    assert len(distances) == len(x) - 1 and distances[:38] == [0.0] * 38 and distances == sorted(distances) and distances[38] > 0
    assert {r.cluster for r in found.collect()} == {0, 1}


def test_lloyd_scans_only_for_starts_that_move(spark, monkeypatch):
    x = np.concatenate([np.random.default_rng(0).normal(size=(40, 2)), np.random.default_rng(1).normal(6, 1, (40, 2))])
    rows, sizes, scan = vectors(spark, x), [], clustering._scan
    monkeypatch.setattr(clustering, "_scan", lambda r, c: (sizes.append(len(c)), scan(r, c))[1])
    done = clustering.lloyd(rows, [x[[0, 79]]])[0][0]
    sizes.clear()
    centres, cost, scans = clustering.lloyd(rows, [done, x[[0, 1]]])
    near = ((x[:, None] - centres[1][None]) ** 2).sum(2)
    assert np.allclose(centres[0], done) and np.isclose(cost[1], near.min(1).sum())
    assert scans == len(sizes) > 1 and sizes[0] == 2 and set(sizes[1:]) == {1}


#: Raster 10233 of a larger table as bytes: thresholds 120 and 123 are equally good, the first counts.
TIED = [170, 74, 152, 132, 153, 95, 105, 18, 180, 89, 73, 210, 0, 177, 127, 233, 123, 56, 97, 28, 108, 135, 143, 139, 116, 255, 145, 255, 129, 71, 64, 159, 101, 193, 114, 139, 77, 145, 147, 51, 88, 90, 120, 206, 63, 108, 152, 151, 180, 186, 117, 149, 134, 88, 0, 86, 160, 64, 195, 123, 111, 92, 64, 167]


def test_otsu_takes_the_first_of_equal_thresholds():
    assert raster.otsu(np.array(TIED, np.uint8)) == 120


def test_equally_far_components_are_equal(spark):
    """Raster 4226 of a larger table: the first component and the third are equally far from the centre."""
    mask = np.array([c == "1" for c in f"{0x4C6B7C60042B0DC1:064b}"]).reshape(8, 8)
    assert segment.pick_component(regions.of(mask), (3.5, 3.5)) == 1
    rows = spark.createDataFrame([(0, r.label, *map(float, r.centroid), r.area) for r in regions.of(mask)], "vec_id int, label int, cy double, cx double, area long")
    assert components.folded(rows, 3.5, 3.5).first().label == 1


@pytest.fixture(scope="module")
def partial_dir(tmp_path_factory, sf_dir):
    """Seven cells: one of four channels, two of one, two of two, two of three."""
    folder = tmp_path_factory.mktemp("partial")
    duckdb.sql(f"COPY (SELECT * FROM '{sf_dir}/embeddings.parquet' WHERE vec_id < 28 AND vec_id % 4 < [4, 1, 1, 2, 2, 3, 3][vec_id // 4 + 1]) TO '{folder}/embeddings.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", ["sample_files", "shape_errors", "composite_channels", "composite_files", "variant_rules_classical", "variant_rules_structural"])
def test_cells_without_all_channels(spark, partial_dir, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{partial_dir}/embeddings.parquet'")
    got, want = queries.QUERIES[name](spark, partial_dir).toPandas(), c.execute(queries.SQL[name]).df()
    assert rows_of(got) == rows_of(want.astype(got.dtypes.to_dict()))  # integers beside nulls


@pytest.mark.parametrize("name", ["variants_classical", "variants_structural"])
def test_variants_of_cells_without_all_channels(spark, partial_dir, name):
    rows = queries.QUERIES[name](spark, partial_dir).collect()
    assert len(rows) == 70 and all(r.error is None and r.crc is not None for r in rows)


def test_kernels_send_on_a_few_images_at_a_time():
    seen = [len(p) for p in few(iter([pd.DataFrame({"x": range(70)}), pd.DataFrame({"x": range(3)}), pd.DataFrame({"x": []})]))]
    assert seen == [32, 32, 6, 3]


def test_tiles_meet_many_at_a_time(spark):
    """Stencils and labels took one call of Python for each tile."""
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(k, pack(rng.random((9, 6)))) for k in range(3)], f"image_id long, image {RASTER.simpleString()}")
    seen = []
    schema = tiles.cut(rows, 4).schema
    pieces = pa.RecordBatch.from_pylist([{"image_id": i, "ty": y, "tx": 0, "piece": pack(np.full((2, 2), y))} for i in (None, 7) for y in range(3) for _ in range(5)], pa.schema([("image_id", pa.int64()), ("ty", pa.int32()), ("tx", pa.int32()), ("piece", to_arrow_schema(schema).field("tile").type)]))
    for batch, starts in tiles._groups(iter([pieces.slice(k, 7) for k in range(0, 30, 7)]), "piece"):
        sizes = np.diff(np.append(starts, batch.num_rows))
        seen += sizes.tolist()
        assert sum(sizes) == batch.num_rows
    assert seen == [5] * 6  # groups that go on in the next batch are whole
    assert [hi - lo for lo, hi in tiles._parts(np.full(5000, 64))] == [2048, 2048, 904]
    assert [hi - lo for lo, hi in tiles._parts(np.array([9, 1, 1, 1]) << 20)] == [1, 2, 1]
    found = tiles.stencil(tiles.cut(rows, 4), lambda a: raster.gaussian(a, 1.5), 6, 4)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert {(r.image_id, r.ty, r.tx) for r in found.collect()} == {(i, y, x) for i in range(3) for y in range(3) for x in range(2)}


def test_pairs_meet_in_few_blocks(spark):
    """Blocks were of 2,048 vectors at any size, so copies of the input grew with its square; a task's nearest pairs with its ties."""
    rng = np.random.default_rng(0)
    x = np.round(np.concatenate([rng.normal(size=(700, 3)), np.repeat(rng.normal(size=(1, 3)), 60, 0)]), 3)
    cluster = np.arange(len(x)) % 3
    rows = spark.createDataFrame([(k, int(c), a.tolist()) for k, (a, c) in enumerate(zip(x, cluster, strict=True))], "id long, cluster int, px array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    i, j = np.triu_indices(len(x), 1)
    order = np.lexsort((j, i, d[i, j]))[:50]
    for block in (None, 100):
        got = evaluate.nearest_pairs(rows, 50, block).collect()
        assert [(r.i, r.j) for r in got] == list(zip(i[order].tolist(), j[order].tolist(), strict=True))
        sums = {(r.id, r.other): (r.n, r.total) for r in evaluate.block_pairs(rows, block).collect()}
        assert len(sums) == 3 * len(x)
        for (p, c), (n, total) in sums.items():
            assert n == (cluster == c).sum() - (cluster[p] == c) and abs(total - d[p, cluster == c].sum()) < 1e-7
        for r in evaluate.intra_cluster_pairs(rows, block).collect():
            own = d[np.ix_(cluster == r.cluster, cluster == r.cluster)]
            own = own[np.triu_indices(len(own), 1)]
            assert np.allclose((r.mean_distance, r.std_distance, r.max_distance), (own.mean(), own.std(), own.max()))

    def pair(x, y):
        return pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int32())})

    many = spark.range(100_000).select("id", F.lit(0).alias("cluster"), F.array(F.col("id").cast("double")).alias("px"))
    met = [r.n for r in evaluate.in_blocks(many, pair, "n int", halves=True).collect()]
    assert len(met) == 16 * 17 // 2 and max(met) < 8000  # 1,225 before


def test_components_of_points_are_found_together(monkeypatch):
    """The intensity predictor labelled every mask of every point by itself."""
    rng = np.random.default_rng(0)
    stack = rng.random((40, 13, 17)) > 0.55
    rows, cols = rng.integers(0, 13, 40), rng.integers(0, 17, 40)
    got = regions.holding(stack, rows, cols)
    for m, r, c, on in zip(stack, rows, cols, got, strict=True):
        labels, _ = regions.label(m)
        assert (on == ((labels == labels[r, c]) if m[r, c] else np.zeros_like(m))).all()
    assert not regions.holding(np.zeros((2, 3, 3), bool), np.array([0, 1]), np.array([0, 2])).any()
    image, points = rng.random((20, 24)), np.array([[0.5, 0.5], [23.9, 19.9], [7.2, 11.0]])
    monkeypatch.setattr(regions, "label", None)  # called 9 times before
    logits, ious = maskops.intensity_predictor(image, points)
    assert logits.shape == (3, 3, 20, 24) and ious.tolist() == [[0.95, 0.9, 0.8]] * 3
    assert all(logits[k, m, int(y), int(x)] == 4 for k, (x, y) in enumerate(points) for m in range(3))


@pytest.mark.parametrize("name", ["cell_files", "sample_files", "verified_files", "copied_files", "composite_files"])
def test_images_that_are_not_written_raise(spark, sf_dir, monkeypatch, tmp_path, name):
    """Their reasons were dropped with the sink's rows, so these queries returned what was left as if it were all."""
    folders = iter([tmp_path / "images", tmp_path / "copies"])
    for file in ("cell3/cell3_Actin.png", "color_3.png"):  # folders in the way of files
        (tmp_path / "images" / file / "full").mkdir(parents=True)
    monkeypatch.setattr(kernel_queries, "scratch", lambda *_: str(next(folders)))
    with pytest.raises(OSError, match="1 of .* images were not written"):
        queries.QUERIES[name](spark, sf_dir).collect()


def test_all_images_are_written_once(spark, tmp_path):
    rows = [("a/x.png", pack(np.zeros((2, 2), np.uint8))), ("b/y.png", pack(np.zeros((2, 2, 3), np.uint8)))]
    schema = f"name string, image {RASTER.simpleString()}"
    assert all_images(spark.createDataFrame(rows, schema), str(tmp_path / "good")) == 2
    assert sorted(p.name for p in (tmp_path / "good").rglob("*") if p.is_file()) == ["x.png", "y.png"]
    bad = spark.createDataFrame([*rows, (None, rows[0][1]), ("c.png", None)], schema)
    assert sorted(r.error for r in write_images(bad, str(tmp_path / "some")).collect() if r.error) == ["ValueError: no image", "ValueError: no name"]
    with pytest.raises(OSError, match="2 of 4 images"):
        all_images(bad, str(tmp_path / "bad"))
