"""The jobs on small synthetic cells: generation to evaluation, export and quality control, masks, streaming."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from spectraframe.config import Config
from spectraframe.functions import png, registry
from spectraframe.operators import evaluate, generate, imaging, maskops
from spectraframe.plans import jobs
from spectraframe.sources import images as sources

CONFIG = replace(Config(), size=(128, 128), n_per_cell=2, n_init=2)


def channel(kind, seed, shape=(140, 150)):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[: shape[0], : shape[1]]
    inside = ((y - 70) / 50) ** 2 + ((x - 75) / 55) ** 2 < 1
    a = {"BF": 0.3 + 0.4 * x / shape[1], "Actin": inside * (0.6 + 0.3 * np.sin(x / (2 + seed % 3))), "Microtubules": inside * (0.5 + 0.4 * np.sin(y / 3)), "Nuclei": ((y - 65) ** 2 + (x - 70) ** 2 < 180) * 0.9}[kind]
    return (np.clip(a + rng.normal(0, 0.02, shape), 0, 1) * 255).astype(np.uint8)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("cells")
    for k, (cell, prefix) in enumerate((("CellA", "CellA"), ("CellB", "PhenotypeI"), ("CellC", "PhenotypeII"))):
        (root / cell).mkdir()
        for kind in ("BF", "Actin", "Microtubules", "Nuclei"):
            shape = (130, 150) if (cell, kind) == ("CellB", "BF") else (140, 150)
            a = channel(kind, 10 * k, shape)
            (root / cell / f"{prefix}_{kind}.png").write_bytes(png.encode(np.stack([a] * 3, -1) if (cell, kind) == ("CellC", "Actin") else a))
    return root


@pytest.fixture(scope="module")
def made(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    return out, jobs.pipeline(spark, str(root), str(out), CONFIG)


def test_pipeline(made):
    out, tables = made
    assert tables["manifest"].count() == 3 + 6 + 6
    assert len(list((out / "images").glob("*.png"))) == 15 * 4
    features = tables["features"].toPandas()
    assert len(features) == 15
    assert not features.isna().any().any()
    assert tables["errors"].count() == 0
    s = tables["summary"].first()
    assert (s.n_images.originals, s.n_images.total) == (3, 15)
    for m in (s.clustering.kmeans, s.clustering.hierarchical):
        assert -1 <= m.silhouette_score <= 1
        assert 0 <= m.parent_match_rate <= 1
    assert tables["labels"].count() == 30
    drawn = {p.stem: png.decode(p.read_bytes()) for p in (out / "figures").glob("*.png")}
    assert set(drawn) == {"image_grid", "pca_clusters", "cluster_comparison", "dendrogram", "correlation_matrix"}
    assert all(a.ndim == 3 and (a != 255).any() for a in drawn.values())
    assert len({c for c in drawn["pca_clusters"].reshape(-1, 3).tolist() for c in [tuple(c)]}) == 1 + tables["labels"].where("method = 'kmeans'").select("cluster").distinct().count()
    assert jobs.figure_grid(tables["manifest"], 5).count() == 8


def test_export_and_quality(spark, made, tmp_path):
    out, _ = made
    done = jobs.export(spark, str(out / "manifest"), str(out / "images"), str(tmp_path / "export"), 3, 4)
    assert done.where("error IS NULL").count() == 7
    results = jobs.quality(spark, str(tmp_path / "export"), str(tmp_path / "qc"), min_keep=21)
    assert results.count() == 4
    assert sources.read_qc(spark, str(tmp_path / "qc" / "filtering_results")).count() == 4
    assert len(list((tmp_path / "qc" / "color_clean").glob("*.png"))) == results.where("passes").count()


def test_more_samples_than_ward_takes(spark, made, monkeypatch):
    """The rest goes on, and hierarchical figures are null."""
    from spectraframe.operators import clustering

    monkeypatch.setattr(clustering, "MOST_WARD", 10)
    labels, summary = jobs.evaluate_clusters(made[1]["features"], CONFIG)
    assert {r.method for r in labels.select("method").distinct().collect()} == {"kmeans"}
    s = summary.first().clustering
    assert s.hierarchical.silhouette_score is None
    assert s.kmeans.silhouette_score is not None


def test_figures():
    from spectraframe.functions import figures

    g = figures.grid([(0, 0, np.zeros((10, 20))), (1, 2, np.full((8, 8, 3), 7, np.uint8))], tile=16, gap=2)
    assert g.shape == (2 * 18 + 2, 3 * 18 + 2, 3)
    assert (g[20 : 20 + 16, 38 : 38 + 16] == 7).all()
    s = figures.scatter([(0, 0, 0), (9, 9, 1)], 10, 10, 1)
    assert (s[1, 1] == figures.COLOURS[0]).all()
    assert (s[10, 10] == figures.COLOURS[1]).all()
    t = figures.tree([(0, 0, 1, 1.0), (1, 2, 3, 2.0), (2, 4, 5, 4.0)], 4, 101, 81)
    dark = (t == 40).all(-1)
    assert dark[5].sum() > 20  # the last merge's bar, at 95 % of the height
    assert dark.any(1).sum() > 90
    assert (figures.tree([], 4) == 255).all()
    part = figures.tree([(1, 2, 3, 2.0), (2, 4, 5, 4.0)], 4, 101, 81)  # without the merge that made 4
    assert (part == 40).any()
    m = figures.matrix(np.array([[1.0, -1.0], [0.0, np.nan]]), 2)
    assert [tuple(m[y, x]) for y, x in ((0, 0), (0, 2), (2, 0), (2, 2))] == [(178, 24, 43), (33, 102, 172), (255, 255, 255), (200, 200, 200)]
    assert figures.beside(s, s).shape == (12, 12 + 12 + 12, 3)


def test_a_file_that_is_no_image_fails_with_a_reason(spark):
    rows = spark.createDataFrame([("color_x.png", bytearray(b"nothing"))], "path string, content binary")
    (r,) = imaging.quality(sources.decoded(rows).withColumn("filename", F.col("path"))).collect()
    assert not r.passes
    assert r.reasons.startswith("Processing error")


def test_missing_channel(spark, root):
    with pytest.raises(FileNotFoundError):
        sources.resolve_channels(spark, str(root), ["CellA", "CellX"])


def test_dry_run_needs_no_files(spark, tmp_path):
    rows = jobs.pipeline(spark, "/nowhere", str(tmp_path), replace(CONFIG, n_per_cell=10), dry_run=True)["manifest"]
    assert rows.count() == 63
    assert rows.select("sample_id").distinct().count() == 63
    assert sources.read_manifest(spark, str(tmp_path / "manifest")).count() == 63


def test_variants_repeat(spark, root):
    cells = jobs.load(spark, str(root), CONFIG)
    a, b = (generate.variants(cells, "alg1", CONFIG).select("sample_id", F.xxhash64("actin.data").alias("h")).orderBy("sample_id").collect() for _ in range(2))
    assert a == b
    assert len({r.h for r in a}) == len(a)


def test_validation(spark):
    rows = spark.createDataFrame([(1.2, float("nan"), 3.0, None), (0.5, float("inf"), 3.0, 2.0)], "circularity double, cell_area double, nc_ratio double, nuclear_area double")
    out = imaging.validated(rows).toPandas()
    assert out["circularity"].tolist() == [1.0, 0.5]
    assert "nc_ratio" not in out
    assert "cell_area" not in out
    assert out["nuclear_area"].tolist() == [0.0, 2.0]


def test_evaluation_edges(spark):
    one = spark.createDataFrame([(1, 0, [0.0, 0.0]), (2, 0, [3.0, 4.0])], "id long, cluster int, px array<double>")
    assert evaluate.silhouette(one).first()["silhouette"] == -1
    assert evaluate.intra_cluster(one).first()["mean_distance"] == 5
    alone = one.unionByName(spark.createDataFrame([(3, 1, [9.0, 9.0])], one.schema))
    assert {r.cluster: r.mean_distance for r in evaluate.intra_cluster(alone).collect()} == {0: 5.0, 1: 0.0}
    assert evaluate.compare_algorithms(alone.withColumn("algorithm", F.lit("alg1"))).first()["n_samples"] == 2
    orphan = spark.createDataFrame([("a_alg1_001", "a", "alg1", False, 0)], "sample_id string, parent_id string, algorithm string, is_original boolean, cluster int")
    assert all(r.matched == 0 for r in evaluate.parent_match(orphan).collect())


def test_blocks_give_the_same_sums(spark, sf_dir):
    from spectraframe.plans.queries import vectors

    rows = vectors(spark, sf_dir)
    a = evaluate.block_pairs(rows, 64).select("id", "other", "n", F.round("total", 6).alias("t"))
    b = evaluate.block_pairs(rows, 10_000).select("id", "other", "n", F.round("total", 6).alias("t"))
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


def test_automatic_masks(spark):
    a = np.zeros((64, 64), np.uint8)
    a[8:24, 8:24], a[36:56, 30:60] = 120, 220
    rows = spark.createDataFrame([("x", sources.pack(a))], "image_id string, image struct<h:int,w:int,c:int,dtype:string,data:binary>")
    found = maskops.automatic_masks(rows, points_per_side=8).toPandas()
    assert {256, 600} <= set(found["area"])
    assert maskops.automatic_masks(rows, points_per_side=8, layers=1, min_region=5).count() >= 2


def test_sql_functions(spark, sf_dir):
    registry.register(spark)
    assert "embeddings" in registry.views(spark, sf_dir)
    r = spark.sql("SELECT nc_ratio(10, 2) AS a, to_byte(0.999) AS b, rle_area(array(1, 2, 3, 4)) AS c, is_original('CellA_Original') AS d, per_cent(0.738) AS e, mask_to_rle(array(false, true, true, false), 2) AS f, (SELECT count(*) FROM embeddings) AS g").first()
    assert (r.a, r.b, r.c, r.d, r.e, list(r.f)) == (0.25, 254, 6, True, "73.8%", [1, 2, 1])
    assert r.g > 0


def test_streaming(spark, made, tmp_path):
    from spectraframe.streaming import ingest

    out, _ = made
    ingest.append_features(spark, str(out / "images"), str(tmp_path / "stream"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stream")).count() == 15


def test_rows_by_index_and_concatenation(spark):
    rows = spark.createDataFrame([(k, f"r{k}") for k in range(5)], "k long, name string")
    assert [r.name for r in maskops.by_index(rows, "k", [3, 0, 3]).orderBy("position").collect()] == ["r3", "r0", "r3"]
    assert maskops.concatenated(rows, rows.select("k")).where("name IS NULL").count() == 5


def test_mode_of_sizes_prefers_the_first_channel(spark):
    sizes = spark.createDataFrame([("a", "actin", 10, 10), ("a", "mt", 20, 20), ("a", "nuc", 20, 20), ("a", "phase", 10, 10), ("b", "nuc", 5, 5), ("b", "mt", 7, 7)], "cell_id string, channel string, h int, w int")
    assert {r.cell_id: (r.h, r.w) for r in sources.mode_size(sizes).collect()} == {"a": (10, 10), "b": (7, 7)}
    assert {r.cell_id: r.ok for r in sources.verify_cells(sizes).collect()} == {"a": False, "b": False}


def test_windowed_counts_of_a_stream(spark, sf_dir, tmp_path):
    from spectraframe.streaming import ingest

    batch = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "in"))
    stream = ingest.event_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("event_counts").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("event_counts").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total")).first()
    want = batch.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")).first()
    assert tuple(got) == tuple(want)
