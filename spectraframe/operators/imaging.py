"""Operators on rasters in rows: one image (or one cell's channels) a row, kernels in Arrow batches, no shuffle.

A kernel that fails gives a row with its reason in `error`, so what was left out can be counted (the jobs drop them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import raster, segment, texture
from ..schemas import FEATURE_ROW, QC_ROW, RASTER
from ..sources.images import few, pack, unpack


def image_of(x: object) -> np.ndarray | None:
    return None if x is None else unpack(x if isinstance(x, dict) else x.asDict())


def mapped(rows: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], image: str = "image") -> DataFrame:
    """rows with `image` replaced by kernel(image), and `error`."""
    schema = StructType([*[f if f.name != image else StructField(image, RASTER) for f in rows.schema.fields if f.name != "error"], StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few(batches):
            out, errors = [], []
            for x in pdf[image]:
                try:
                    out.append(pack(kernel(image_of(x))))
                    errors.append(None)
                except Exception as e:  # the row keeps the reason
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.drop(columns="error", errors="ignore").assign(**{image: out, "error": errors})[schema.fieldNames()]

    return rows.mapInPandas(run, schema)


def wide(channel_rows: DataFrame, *keys: str) -> DataFrame:
    """One row a sample, one column a channel, from (keys, channel, image)."""
    return channel_rows.groupBy(*keys).agg(*[F.first(F.when(F.col("channel") == c, F.col("image")), ignorenulls=True).alias(c) for c in ("phase", "actin", "mt", "nuc")])


def masks_of(actin: np.ndarray | None, nuc: np.ndarray | None, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """M4, M5, M9: the pipeline's cell, nucleus and cytoplasm masks."""
    cell = segment.pipeline_cell_mask(actin, shape)
    nucleus = segment.nuclei(nuc, cell).mask if nuc is not None else np.zeros(cell.shape, bool)
    return cell, nucleus, segment.cytoplasm(cell, nucleus)


def features(samples: DataFrame) -> DataFrame:
    """A17 over (sample_id, parent_id, algorithm, phase, actin, mt, nuc): the feature row of each sample and `error`."""
    schema = StructType([*FEATURE_ROW.fields, StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few(batches):
            out = []
            for row in pdf.itertuples(index=False):
                values, error = dict.fromkeys(texture.FEATURES), None
                try:
                    phase, actin, mt, nuc = (None if x is None else raster.by_255(x) for x in map(image_of, (row.phase, row.actin, row.mt, row.nuc)))
                    there = [x for x in (phase, actin, mt, nuc) if x is not None]
                    if not there:
                        raise ValueError("no channel")
                    if len({x.shape for x in there}) > 1:
                        raise ValueError("channels of different shapes")
                    values = texture.all_features(actin, mt, phase, *masks_of(actin, nuc, there[0].shape))
                except Exception as e:  # the row keeps the reason
                    error = f"{type(e).__name__}: {e}"
                out.append((row.sample_id, row.parent_id, row.algorithm, *values.values(), error))
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return samples.select("sample_id", "parent_id", "algorithm", "phase", "actin", "mt", "nuc").mapInPandas(run, schema)


def validated(rows: DataFrame) -> DataFrame:
    """Q5: null, NaN and infinite features as 0, circularity in [0, 1], constant features dropped. What is dropped depends on
    the data, so this reads it once for one row of distinct counts."""
    from .evaluate import filled

    names = [c for c in rows.columns if c in texture.FEATURES]
    rows = filled(rows, names)
    rows = rows.withColumn("circularity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "circularity"))) if "circularity" in names else rows
    distinct = rows.agg(*[(F.min(c) == F.max(c)).alias(c) for c in names]).first()
    return rows.drop(*[c for c in names if distinct[c] is None or distinct[c]])


MEASURES = StructType([StructField("edge_density", DoubleType()), StructField("nucleus_area", DoubleType()), StructField("nucleus_num_components", IntegerType()), StructField("cell_area", DoubleType()), StructField("cell_num_components", IntegerType())])


def quality(images: DataFrame, min_keep: int = 21) -> DataFrame:
    """Q3, Q4 over (filename, image[, error]): strict limits; if fewer than min_keep pass, wider ones for all. Each image is
    measured once; both scores come from its measures."""
    part = [StructField(f"{k}_passes", QC_ROW["passes"].dataType) for k in ("strict", "relaxed")] + [StructField(f"{k}_reasons", ArrayType(StringType())) for k in ("strict", "relaxed")]
    schema = StructType([StructField("filename", StringType()), *MEASURES.fields, *part])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few(batches):
            out = []
            for name, x in zip(pdf["filename"], pdf["image"], strict=True):
                try:
                    m = segment.measure(image_of(x))
                    a, b = segment.score(m), segment.score(m, segment.RELAXED)
                    out.append((name, *m, a.passes, b.passes, a.reasons, b.reasons))
                except Exception as e:  # a failing row, with the reason
                    why = [f"Processing error: {e}"]
                    out.append((name, 0.0, 0.0, 0, 0.0, 0, False, False, why, why))
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return relax_once(images.select("filename", "image").mapInPandas(run, schema), min_keep)


def relax_once(scored: DataFrame, min_keep: int) -> DataFrame:
    """Q4: which of the two scores counts, by how many pass the strict one (an aggregate of one row)."""
    total = scored.agg(F.count_if("strict_passes").alias("n_strict"))
    rows = scored.join(F.broadcast(total))  # one row
    strict = F.col("n_strict") >= min_keep
    passes = F.when(strict, F.col("strict_passes")).otherwise(F.col("relaxed_passes"))
    reasons = F.when(strict, F.array_join("strict_reasons", "; ")).otherwise(F.array_join("relaxed_reasons", "; "))
    label = F.when(passes, F.when(strict, "PASS").otherwise("PASS (relaxed)")).otherwise(reasons)
    keep = [c for c in scored.columns if not c.startswith(("strict_", "relaxed_"))]
    return rows.select(*keep[:1], passes.alias("passes"), *keep[1:], label.alias("reasons"))


def totals(qc: DataFrame) -> DataFrame:
    """A34."""
    return qc.agg(F.count(F.lit(1)).alias("total"), F.count_if("passes").alias("kept"), F.count_if(~F.col("passes")).alias("rejected"))


COLOURS = ("actin", "mt", "nuc")


def composites(cells: DataFrame, partial: bool = False) -> DataFrame:
    """P8 over (sample_id, actin, mt, nuc): (sample_id, image, error). A missing channel is an error; or, if `partial`, black and named in
    `missing`, and `phase` (needed then) gives the shape where it is all there is."""
    schema = StructType([StructField("sample_id", StringType()), StructField("image", RASTER), StructField("error", StringType())])
    if partial:
        schema = schema.add(StructField("missing", ArrayType(StringType())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few(batches):
            out = []
            for row in pdf.to_dict("records"):
                image, error = None, None
                parts = [image_of(row[c]) for c in COLOURS]
                missing = [c for c, x in zip(COLOURS, parts, strict=True) if x is None]
                try:
                    if partial and missing:
                        shape = next(x for x in (*parts, image_of(row["phase"])) if x is not None).shape
                        parts = [np.zeros(shape) if x is None else x for x in parts]
                    image = pack(raster.composite(*parts))
                except Exception as e:  # the row keeps the reason
                    error = f"{type(e).__name__}: {e}"
                out.append((row["sample_id"], image, error, missing)[: len(schema)])
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return cells.select("sample_id", *COLOURS, *(["phase"] if partial else [])).mapInPandas(run, schema)


def enlarged(cells: DataFrame, key: str, size: tuple[int, int], side: int = 8, names: tuple[str, ...] = ("phase", "actin", "mt", "nuc")) -> DataFrame:
    """Small rasters in arrays of values, one column a channel, as stretched images of a size: (sample_id, channels). A null stays null."""
    schema = StructType([StructField("sample_id", StringType()), *[StructField(n, RASTER) for n in names]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few(batches):
            out = {n: [None if x is None else pack(raster.resize(raster.stretch(np.array(x, float).reshape(-1, side)), size).astype(np.float32)) for x in pdf[n]] for n in names}
            yield pd.DataFrame({"sample_id": pdf[key].astype(str)} | out)

    return cells.select(key, *names).mapInPandas(run, schema)
