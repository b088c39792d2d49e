"""Queries of operators on tiles: rasters of 8 by 8 cut into tiles of 4 by 4, with the SQL of the same operators on whole rasters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import raster, regions
from ..operators import tiles
from ..schemas import RASTER
from .queries import CC, PROPS, SQL, images, masked, packed, query, rounded

SIDE = 4


def _tiles(rows: DataFrame, column: str) -> DataFrame:
    return tiles.cut(rows.select("vec_id", column).mapInPandas(lambda b: packed(b, column), f"image_id long, image {RASTER.simpleString()}"), SIDE)


def _mask_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(masked(spark, sf_dir), "m")


def _pixels(found: DataFrame) -> DataFrame:
    return rounded(tiles.values(found).withColumnRenamed("image_id", "vec_id"))


def _stencil(spark: SparkSession, sf_dir: str, kernel: Callable[[np.ndarray], np.ndarray], radius: int, mode: str = "reflect") -> DataFrame:
    return _pixels(tiles.stencil(_tiles(images(spark, sf_dir), "px"), kernel, radius, SIDE, mode))


@query(CC + "SELECT * FROM t2")
def tiled_component_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: components over tiles' borders."""
    return rounded(tiles.Labelled(_mask_tiles(spark, sf_dir), SIDE).components().withColumnRenamed("image_id", "vec_id").select(*PROPS))


@query(SQL["largest_component"])
def tiled_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest component's tiles, put through the properties again."""
    found = tiles.Labelled(_mask_tiles(spark, sf_dir), SIDE)
    all_ = found.components()
    kept = tiles.Labelled(found.chosen(all_.groupBy("image_id").agg(F.max_by("root", F.struct("area", -F.col("root"))).alias("root"))), SIDE).components()
    names = all_.select("image_id", "root", "label")
    return rounded(kept.drop("label").join(names, ["image_id", "root"]).withColumnRenamed("image_id", "vec_id").select(*PROPS))


@query(SQL["remove_small"])
def tiled_remove_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6, F7."""
    left = tiles.Labelled(tiles.remove_small(_mask_tiles(spark, sf_dir), SIDE, 3, 8), SIDE).components()
    return left.groupBy(F.col("image_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n_components"), F.sum("area").alias("area"))


@query(SQL["fill_holes"])
def tiled_fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2."""
    filled = tiles.values(tiles.fill_holes(_mask_tiles(spark, sf_dir), SIDE))
    return filled.groupBy(F.col("image_id").alias("vec_id")).agg(F.sum("v").cast("long").alias("area"))


@query(SQL["kernel_gaussian"])
def tiled_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radius is larger than a tile."""
    return _stencil(spark, sf_dir, lambda a: raster.gaussian(a, 1.5), 6)


@query(SQL["kernel_sobel_magnitude"])
def tiled_sobel_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, P13, W7."""
    return _stencil(spark, sf_dir, raster.sobel_magnitude, 1)


@query(SQL["kernel_median_3"])
def tiled_median_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15."""
    return _stencil(spark, sf_dir, lambda a: raster.median(a, 3), 3, "nearest")


@query(SQL["kernel_closing_3"])
def tiled_closing_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: a dilation, then an erosion; beyond the image is off for the one and on for the other."""
    grown = tiles.stencil(_mask_tiles(spark, sf_dir), lambda a: regions.dilate(a, 3), 3, SIDE, "constant", False)
    closed = tiles.values(tiles.stencil(grown, lambda a: regions.erode(a, 3), 3, SIDE, "constant", True)).withColumnRenamed("image_id", "vec_id")
    on, at = F.col("v") > 0, 8 * F.col("r") + F.col("c")
    return closed.groupBy("vec_id").agg(F.count_if(on).alias("area"), F.sum(F.when(on, at).otherwise(0)).alias("places"))
