"""Jobs: generation to evaluation (A), export and quality control (B), automatic masks (C); section 3.

    python -m spectraframe.plans.jobs pipeline --data-root DIR --output-dir DIR [--n-per-cell N] [--dry-run]
    python -m spectraframe.plans.jobs export --manifest CSV --output-dir DIR [--n-gray N] [--n-color N]
    python -m spectraframe.plans.jobs quality --input DIR --output DIR [--min-keep N]
    python -m spectraframe.plans.jobs masks --input DIR --output DIR
"""

from __future__ import annotations

import argparse
import functools
import logging
from dataclasses import replace
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CHANNELS, Config
from ..functions import figures, png, raster
from ..functions.texture import FEATURES
from ..operators import clustering, evaluate, generate, imaging, maskops
from ..sources import images as sources

log = logging.getLogger("spectraframe")


def setup_logging(folder: str, verbose: bool = False) -> None:
    """To a file and the console."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    logging.basicConfig(level=logging.DEBUG if verbose else logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=[logging.FileHandler(Path(folder) / "errors.log"), logging.StreamHandler()], force=True)


def load(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """(cell_id, phase, actin, mt, nuc) of all cells, checked."""
    rows = sources.load_cells(spark, root, list(config.cells)).persist()
    if not rows.agg(sources.expected_cells(rows, list(config.cells))).first()[0]:
        raise ValueError(f"the cells found are not exactly {', '.join(config.cells)}")
    sizes = rows.select("cell_id", "channel", "image.h", "image.w")
    bad = [r.cell_id for r in sources.verify_cells(sizes).where("NOT ok").take(5)]
    if bad:
        raise ValueError(f"cells that fail the checks before generation: {', '.join(bad)}")
    return imaging.wide(imaging.mapped(rows.select("cell_id", "channel", "image"), lambda a: raster.resize(raster.to_float(a), config.size)).drop("error"), "cell_id")


def make(cells: DataFrame, config: Config, folder: str) -> tuple[DataFrame, DataFrame]:
    """Originals and variants written as PNG; the manifest, and the errors (sample_id, stage, message)."""
    originals = cells.select(F.concat("cell_id", F.lit("_original")).alias("sample_id"), F.col("cell_id").alias("parent_id"), F.lit("original").alias("algorithm"), *CHANNELS, F.lit(None).cast("string").alias("error"))
    rows = originals
    for algorithm in ("alg1", "alg2"):
        rows = rows.unionByName(generate.variants(cells, algorithm, config))
    rows = rows.persist()
    errors = rows.where("error IS NOT NULL").select("sample_id", F.lit("generate").alias("stage"), F.col("error").alias("message"))
    flat = rows.select("sample_id", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("image")) for c in CHANNELS])).alias("x")).where("x.image IS NOT NULL")
    named = flat.select(F.concat("sample_id", F.lit("_"), "x.channel", F.lit(".png")).alias("name"), "x.image")
    done = sources.write_images(named, folder).persist()
    errors = errors.unionByName(done.where("error IS NOT NULL").select("name", F.lit("write").alias("stage"), F.col("error").alias("message")).toDF("sample_id", "stage", "message"))
    paths = done.where("path IS NOT NULL").select(F.regexp_extract("name", "^(.*)_[a-z]+\\.png$", 1).alias("sample_id"), F.regexp_extract("name", "_([a-z]+)\\.png$", 1).alias("channel"), "path")
    by_sample = paths.groupBy("sample_id").agg(*[F.max(F.when(F.col("channel") == c, F.col("path"))).alias(f"path_{c}") for c in CHANNELS])
    return rows.select("sample_id", "parent_id", "algorithm").join(by_sample, "sample_id"), errors


def read_samples(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest's images as one row a sample."""
    paths = manifest.select("sample_id", "parent_id", "algorithm", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"path_{c}").alias("p")) for c in CHANNELS])).alias("x")).where("x.p IS NOT NULL").select("sample_id", "parent_id", "algorithm", "x.channel", F.regexp_extract("x.p", "([^/]+)$", 1).alias("name"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "path", "length")
    images = sources.opened(sources.spread(files.join(paths.select("name").distinct(), "name", "left_semi"))).select("name", "image")
    return imaging.wide(paths.join(images, "name", "left"), "sample_id", "parent_id", "algorithm")


def evaluate_clusters(features: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(sample_id, method, cluster) and the one-row summary of both clusterings; without Ward's, whose figures are null then,
    where there are more samples than it takes."""
    spark = features.sparkSession
    names = [c for c in features.columns if c in FEATURES]
    z = evaluate.standardized(features, names).select("sample_id", "parent_id", "algorithm", F.array(*names).alias("px"))
    z = z.withColumn("id", F.xxhash64("sample_id")).persist()
    labels, columns = {}, {"hierarchical": (None, None, None)}
    labels["kmeans"] = clustering.kmeans(z, config.n_clusters, config.n_init, config.seed)[0].select("id", "cluster")
    if z.count() <= clustering.MOST_WARD:
        labels["hierarchical"] = clustering.ward(z, config.n_clusters)[0]
    else:
        log.warning("no hierarchical clustering: more than %d samples", clustering.MOST_WARD)
    for method, found in labels.items():
        rows = z.join(found, "id").withColumn("is_original", F.lower("sample_id").contains("original")).persist()
        match = evaluate.parent_match(rows).where("parent_id = '*' AND algorithm = '*'").first()
        sums = evaluate.block_pairs(rows.select("id", F.col("cluster").cast("int").alias("cluster"), "px"), within=True).agg(F.sum("total").alias("t"), F.sum("n").alias("n")).first()
        score = evaluate.silhouette(rows.select("id", F.col("cluster").cast("int").alias("cluster"), "px")).first()["silhouette"]
        columns[method] = (float(score), float(match["rate"]) if match else 0.0, float(sums["t"] / sums["n"]) if sums["n"] else 0.0)
        labels[method] = rows.select("sample_id", F.lit(method).alias("method"), "cluster", "id", "px", "algorithm", "parent_id", "is_original")
    by = {r["algorithm"]: r for r in evaluate.compare_algorithms(labels["kmeans"].select("id", F.col("cluster").cast("int").alias("cluster"), "px", "algorithm")).collect()}  # a row an algorithm
    rates = {r["algorithm"]: r["rate"] for r in evaluate.parent_match(labels["kmeans"]).where("algorithm <> '*'").collect()}
    counts = {r["algorithm"]: r["count"] for r in z.groupBy("algorithm").count().collect()}
    part = "struct<silhouette_score:double,parent_match_rate:double,mean_intra_cluster_distance:double>"
    schema = f"n_images struct<originals:int,alg1:int,alg2:int,total:int>, clustering struct<kmeans:{part},hierarchical:{part}>, algorithm_comparison struct<alg1_match_rate:double,alg2_match_rate:double,alg1_mean_intra_distance:double,alg2_mean_intra_distance:double,alg1_n_samples:int,alg2_n_samples:int>"
    n = [counts.get(k, 0) for k in ("original", "alg1", "alg2")]
    compared = [rates.get(k, 0.0) for k in ("alg1", "alg2")] + [by[k]["mean_intra_distance"] if k in by else 0.0 for k in ("alg1", "alg2")] + n[1:]
    summary = spark.createDataFrame([((*n, sum(n)), (columns["kmeans"], columns["hierarchical"]), tuple(compared))], schema)
    named = [found.select("sample_id", "method", "cluster") for found in labels.values()]
    return functools.reduce(DataFrame.unionByName, named), summary


def pipeline(spark: SparkSession, data_root: str, output: str, config: Config = Config(), dry_run: bool = False) -> dict[str, DataFrame]:
    """Entry point A. The tables it made: manifest, and unless dry_run features, errors, labels, summary, pca."""
    if dry_run:
        rows = generate.manifest(spark.createDataFrame([(c,) for c in config.cells], "cell_id string"), config.n_per_cell, output)
        sources.write_csv(rows, f"{output}/manifest")
        return {"manifest": rows}
    manifest, errors = make(load(spark, data_root, config), config, f"{output}/images")
    sources.write_csv(manifest, f"{output}/manifest")
    manifest = sources.read_manifest(spark, f"{output}/manifest")
    made = imaging.features(read_samples(spark, manifest, f"{output}/images")).persist()
    errors = errors.unionByName(made.where("error IS NOT NULL").select("sample_id", F.lit("features").alias("stage"), F.col("error").alias("message")))
    features = imaging.validated(made.where("error IS NULL").drop("error"))
    sources.write_csv(features, f"{output}/features")
    errors.write.mode("overwrite").parquet(f"{output}/errors")
    labels, summary = evaluate_clusters(features, config)
    labels.write.mode("overwrite").parquet(f"{output}/labels")
    sources.write_summary(summary, output)
    names = [c for c in features.columns if c in FEATURES]
    z = evaluate.standardized(features, names).select(F.col("sample_id").alias("id"), F.array(*names).alias("px"))
    points, _ = clustering.pca(z)
    points.write.mode("overwrite").parquet(f"{output}/pca")
    tables = {"manifest": manifest, "features": features, "errors": errors, "labels": labels, "summary": summary, "pca": points}
    draw(spark, tables, output)
    return tables


def figure_grid(manifest: DataFrame, n: int = 15, seed: int = 42, columns: int = 6) -> DataFrame:
    """V1: the originals and n sampled variants, with their place in a grid (as many rows as the figure shows)."""
    from pyspark.sql import Window

    original = F.lower("sample_id").contains("original")
    rows = manifest.where(original).unionByName(generate.sample(manifest.where(~original), "sample_id", n, seed))
    k = F.row_number().over(Window.orderBy(F.lower("sample_id").contains("original").desc(), "sample_id")) - 1
    return rows.withColumn("k", k).withColumns({"row": F.floor(F.col("k") / columns).cast("int"), "column": (F.col("k") % columns).cast("int")})


def scattered(points: DataFrame, h: int = 480, w: int = 640) -> list[tuple[int, int, int]]:
    """Points (pc, cluster) as (row, column, cluster) on a figure: one a pixel and cluster, so as many as it can show."""
    x, y = F.get("pc", 0), F.get("pc", 1)
    edge = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if edge[0] is None:
        return []
    column = F.round((x - edge[0]) / ((edge[1] - edge[0]) or 1.0) * (w - 1)).cast("int")
    row = F.round((edge[3] - y) / ((edge[3] - edge[2]) or 1.0) * (h - 1)).cast("int")
    return [tuple(r) for r in points.select(row.alias("r"), column.alias("c"), F.col("cluster").cast("int").alias("k")).distinct().orderBy("r", "c", "k").collect()]


def draw(spark: SparkSession, tables: dict[str, DataFrame], output: str) -> list[str]:
    """The figures of a run as PNG: image grid, clusters over two components, merges, correlations, both clusterings
    side by side. What is gathered is what a figure shows."""
    shown = read_samples(spark, figure_grid(tables["manifest"]).drop("k", "row", "column"), f"{output}/images")
    places = figure_grid(tables["manifest"]).select("sample_id", "row", "column")
    tiles = imaging.composites(shown).where("error IS NULL").join(places, "sample_id").collect()
    made = {"image_grid": figures.grid([(r["row"], r["column"], sources.unpack(r["image"].asDict())) for r in tiles])}
    features = tables["features"]
    names = [c for c in features.columns if c in FEATURES]
    found = {(r["a"], r["b"]): r["corr"] for r in evaluate.correlation_long(features.select(*names), names).collect()}
    made["correlation_matrix"] = figures.matrix(np.array([[np.nan if found.get((a, b)) is None else found[a, b] for b in names] for a in names], float))
    scores = tables["pca"].join(tables["labels"], F.col("id") == F.col("sample_id"))
    parts = {m: figures.scatter(scattered(scores.where(F.col("method") == m))) for m in ("kmeans", "hierarchical")}
    made |= {"pca_clusters": parts["kmeans"], "cluster_comparison": figures.beside(*parts.values())}
    z = evaluate.standardized(features, names).select(F.xxhash64("sample_id").alias("id"), F.array(*names).alias("px"))
    if (n := z.count()) <= clustering.MOST_WARD:
        merges = clustering.dendrogram(clustering.ward(z)[1], n).orderBy("step").collect()
        made["dendrogram"] = figures.tree([(r["step"], r["a"], r["b"], r["distance"]) for r in merges], n)
    return [sources.put(f"{output}/figures", f"{name}.png", png.encode(a)) for name, a in made.items()]


def export(spark: SparkSession, manifest_path: str, images: str, output: str, n_gray: int = 9, n_color: int = 21) -> DataFrame:
    """Entry point B, first half: gray channels and colour composites of seeded samples as PNG; (name, path, error)."""
    manifest = sources.read_manifest(spark, manifest_path)
    samples = read_samples(spark, manifest, images)
    present = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in CHANNELS]), lambda c: c.isNotNull())
    gray = generate.sample(samples.where(F.size(present) > 0), "sample_id", n_gray, 42).withColumn("channel", generate.pick_channel(F.col("sample_id"), present, 42))
    image = F.coalesce(*[F.when(F.col("channel") == c, F.col(c)) for c in CHANNELS])
    gray = imaging.mapped(gray.select(F.concat(F.lit("gray_"), "sample_id", F.lit("_"), "channel", F.lit(".png")).alias("name"), image.alias("image")), lambda a: raster.to_byte(raster.stretch(a))).drop("error")
    color = generate.sample(samples.where("actin IS NOT NULL AND mt IS NOT NULL AND nuc IS NOT NULL"), "sample_id", n_color, 43)
    color = imaging.composites(color).where("error IS NULL").select(F.concat(F.lit("color_"), "sample_id", F.lit(".png")).alias("name"), "image")
    return sources.write_images(gray.unionByName(color), output).persist()


def quality(spark: SparkSession, folder: str, output: str, min_keep: int = 21) -> DataFrame:
    """Entry point B, second half: composites are scored, the accepted ones copied, results written; the results."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "color_*.png").load(folder).select("path", "content")
    images = sources.decoded(files).withColumn("filename", F.regexp_extract("path", "([^/]+)$", 1))
    results = imaging.quality(images, min_keep).persist()
    sources.write_csv(results.orderBy("filename"), f"{output}/filtering_results")
    accepted = images.select("path", "filename").join(results.where("passes").select("filename"), "filename", "left_semi")
    log.info("copied %d of %d", sources.copy_files(accepted.select("path"), f"{output}/color_clean").count(), results.count())
    return results


def automatic_masks(spark: SparkSession, folder: str, output: str, **options: object) -> DataFrame:
    """Entry point C: annotations of each PNG in a folder, as JSON lines."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path", "content")
    images = sources.decoded(files).where("error IS NULL").select(F.col("path").alias("image_id"), "image")
    found = maskops.automatic_masks(images, **options)  # type: ignore[arg-type]
    found.write.mode("overwrite").json(output)
    return spark.read.schema(found.schema).json(output)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spectraframe")
    sub = parser.add_subparsers(dest="job", required=True)
    options = {"pipeline": ("data-root", "output-dir"), "export": ("manifest", "images", "output-dir"), "quality": ("input", "output"), "masks": ("input", "output")}
    parsers = {name: sub.add_parser(name) for name in options}
    for name, needed in options.items():
        for o in needed:
            parsers[name].add_argument(f"--{o}", required=True)
        parsers[name].add_argument("--verbose", action="store_true")
    parsers["pipeline"].add_argument("--n-per-cell", type=int, default=Config.n_per_cell)
    parsers["pipeline"].add_argument("--dry-run", action="store_true")
    parsers["export"].add_argument("--n-gray", type=int, default=9)
    parsers["export"].add_argument("--n-color", type=int, default=21)
    parsers["quality"].add_argument("--min-keep", type=int, default=Config.min_keep)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("spectraframe").getOrCreate()
    setup_logging(getattr(a, "output_dir", None) or a.output, a.verbose)
    if a.job == "pipeline":
        pipeline(spark, a.data_root, a.output_dir, replace(Config(), n_per_cell=a.n_per_cell), a.dry_run)
    elif a.job == "export":
        failed = export(spark, a.manifest, a.images, a.output_dir, a.n_gray, a.n_color).where("error IS NOT NULL").orderBy("name").collect()  # n_gray and n_color at most
        if failed:
            raise OSError(f"{len(failed)} images were not written to {a.output_dir}: {failed[0].name}: {failed[0].error}")
    elif a.job == "quality":
        quality(spark, a.input, a.output, a.min_keep)
    else:
        automatic_masks(spark, a.input, a.output)


if __name__ == "__main__":
    main()
