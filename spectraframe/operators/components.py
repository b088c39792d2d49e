"""Connected components of mask columns (A1, A2, F6, F7, W1): one image a row in, one component a row out, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import regions


def component_table(images: DataFrame, side: int = 8, id_col: str = "vec_id", mask_col: str = "m", connectivity: int = 8) -> DataFrame:
    """(id, label, area, r0, c0, r1, c1, cy, cx, major, minor, perimeter) of each component of (id, mask as an array)."""
    schema = "image_id long, label int, area long, r0 int, c0 int, r1 int, c1 int, cy double, cx double, major double, minor double, perimeter double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, m in zip(pdf[id_col], pdf[mask_col], strict=True):
                for r in regions.regions(*regions.label(np.array(m, bool).reshape(-1, side), connectivity)):
                    out.append((i, r.label, r.area, *r.bbox, *r.centroid, r.major, r.minor, r.perimeter))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return images.select(id_col, mask_col).mapInPandas(run, schema).withColumnRenamed("image_id", id_col)


def largest(components: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The largest component of each image, the first of equals."""
    w = Window.partitionBy(id_col).orderBy(F.desc("area"), "label")
    return components.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def of_area(components: DataFrame, least: int, most: int | None = None) -> DataFrame:
    """F6, F7."""
    kept = components.where(F.col("area") >= least)
    return kept if most is None else kept.where(F.col("area") <= most)


def union_props(components: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The area-weighted centroid and the union of boxes of an image's components."""
    return components.groupBy(id_col).agg(F.sum("area").alias("area"), (F.sum(F.col("cy") * F.col("area")) / F.sum("area")).alias("cy"), (F.sum(F.col("cx") * F.col("area")) / F.sum("area")).alias("cx"), F.min("r0").alias("r0"), F.min("c0").alias("c0"), F.max("r1").alias("r1"), F.max("c1").alias("c1"))


def labelled_pixels(images: DataFrame, side: int = 8, id_col: str = "vec_id", mask_col: str = "m", connectivity: int = 8) -> DataFrame:
    """(id, labels): each pixel's component as an array, 0 for background."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            labels = [regions.label(np.array(m, bool).reshape(-1, side), connectivity)[0].ravel().tolist() for m in pdf[mask_col]]
            yield pd.DataFrame({"image_id": pdf[id_col], "labels": labels})

    return images.select(id_col, mask_col).mapInPandas(run, "image_id long, labels array<int>").withColumnRenamed("image_id", id_col)


def overlapping(images: DataFrame, rough_col: str, side: int = 8, id_col: str = "vec_id", mask_col: str = "m") -> DataFrame:
    """(id, label, overlap): the component with most pixels in another mask, the first of equals; none without components."""
    labels = labelled_pixels(images, side, id_col, mask_col).join(images.select(id_col, rough_col), id_col)
    flat = labels.select(id_col, F.explode(F.arrays_zip(F.col("labels").alias("k"), F.col(rough_col).alias("on"))).alias("x")).where("x.k > 0")
    counts = flat.groupBy(id_col, F.col("x.k").alias("label")).agg(F.count_if("x.on").alias("overlap"))
    return counts.groupBy(id_col).agg(F.max_by("label", F.struct("overlap", -F.col("label"))).alias("label"), F.max("overlap").alias("overlap"))


def filled(images: DataFrame, side: int = 8, id_col: str = "vec_id", mask_col: str = "m") -> DataFrame:
    """M2: (id, mask) with holes filled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"image_id": pdf[id_col], "mask": [regions.fill_holes(np.array(m, bool).reshape(-1, side)).ravel().tolist() for m in pdf[mask_col]]})

    return images.select(id_col, mask_col).mapInPandas(run, "image_id long, mask array<boolean>").withColumnsRenamed({"image_id": id_col, "mask": mask_col})


def folded(components: DataFrame, cy: float, cx: float, id_col: str = "vec_id", large: int = 500) -> DataFrame:
    """(id, label): the sequential choice among an image's components, in label order, as a fold over its array."""
    dy, dx = F.col("cy") - cy, F.col("cx") - cx
    d = F.sqrt(dy * dy + dx * dx)
    rows = components.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("label", d.alias("d"), "area"))).alias("c"))
    start = F.struct(F.lit(None).cast("int").alias("label"), F.lit(float("inf")).alias("d"))

    def step(best, x):
        take = (x["d"] < best["d"]) | ((x["d"] < 1.5 * best["d"]) & (x["area"] > large))
        return F.when(take, F.struct(x["label"].alias("label"), x["d"].alias("d"))).otherwise(best)

    return rows.select(id_col, F.aggregate("c", start, step)["label"].alias("label"))
