"""A promptable segmenter as Spark steps: an image is embedded once, prompts are encoded as columns, and batches of prompts meet their image's
embedding (X2, X3, X5, X7). The two networks are arguments; everything around them is here.

`embedded` writes one row an image. `encoded` is array expressions over a given matrix of frequencies and label vectors, without Python. `predicted`
deals each image's prompts into batches, sends the embedding once to each batch, and calls the decoder once a batch; an image with
very many prompts is many batches in many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import masks, raster
from ..schemas import RASTER
from ..sources.rasters import pack, unpack
from .tables import written

#: (1, 3, side, side) of a normalised image to its embedding (channels, h, w).
Encoder = Callable[[np.ndarray], np.ndarray]
#: An embedding and tokens (n, tokens, width) to logits (n, 4, h, w) of the padded square and predicted ious (n, 4).
Decoder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Weights:
    """What encoding takes from a trained model: frequencies (2 rows), and a vector for each kind of point."""

    matrix: list[list[float]]
    not_a_point: list[float]
    background: list[float]
    foreground: list[float]
    low_corner: list[float]
    high_corner: list[float]


def _vector(values: list[float]) -> Column:
    return F.array(*map(F.lit, map(float, values)))


def position(x: Column, y: Column, h: int, w: int, matrix: list[list[float]]) -> Column:
    """Sines, then cosines, of the point in [-1, 1] projected on each frequency."""
    waves = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(*matrix, strict=True)])
    u, v = 2 * x / w - 1, 2 * y / h - 1
    angles = F.transform(waves, lambda g: 2 * math.pi * (u * g["a"] + v * g["b"]))
    return F.concat(F.transform(angles, F.sin), F.transform(angles, F.cos))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def encoded(prompts: DataFrame, h: int, w: int, weights: Weights) -> DataFrame:
    """Prompts (image_id, prompt_id, points, box) and `tokens`: a vector for each point (x, y, label: 1 foreground, 0 background, -1 none), one
    more that is no point if there are points but no box, and two for the box's corners. Coordinates are those of the model's input;
    points or box can be null."""

    def at(x: Column, y: Column) -> Column:
        return position(x + 0.5, y + 0.5, h, w, weights.matrix)

    def token(p: Column) -> Column:
        here = at(p["x"], p["y"])
        return F.when(p["label"] == -1, _vector(weights.not_a_point)).when(p["label"] == 0, _plus(here, _vector(weights.background))).when(p["label"] == 1, _plus(here, _vector(weights.foreground))).otherwise(here)

    none = F.array().cast("array<array<double>>")
    points, box = F.col("points"), F.col("box")
    own = F.when(points.isNull(), none).otherwise(F.concat(F.transform(points, token), F.when(box.isNull(), F.array(_vector(weights.not_a_point))).otherwise(none)))
    corners = F.array(_plus(at(box["x0"], box["y0"]), _vector(weights.low_corner)), _plus(at(box["x1"], box["y1"]), _vector(weights.high_corner)))
    return prompts.withColumn("tokens", F.concat(own, F.when(box.isNull(), none).otherwise(corners)))


def scaled(prompts: DataFrame, sizes: DataFrame, side: int) -> DataFrame:
    """P20: prompts in the coordinates of their images (image_id, height, width) as those of the input, whose longer side is `side`."""
    rows = prompts.join(sizes.select("image_id", "height", "width"), "image_id")
    longest = F.greatest("height", "width")
    fx, fy = (F.floor(F.col(c) * side / longest + 0.5) / F.col(c) for c in ("width", "height"))
    points = F.transform("points", lambda p: F.struct((p["x"] * fx).alias("x"), (p["y"] * fy).alias("y"), p["label"].alias("label")))
    box = F.when(F.col("box").isNotNull(), F.struct(*[(F.col(f"box.{c}{k}") * f).alias(f"{c}{k}") for k in (0, 1) for c, f in (("x", fx), ("y", fy))]))
    return rows.withColumns({"points": points, "box": box}).drop("height", "width")


def embedded(images: DataFrame, encoder: Encoder, side: int = 1024, mean: tuple = (123.675, 116.28, 103.53), std: tuple = (58.395, 57.12, 57.375)) -> DataFrame:
    """(image_id, height, width, embedding) of (image_id, image), written: the encoder is called once an image, whatever is asked later."""
    schema = StructType([images.schema["image_id"], StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("embedding", RASTER)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = unpack(row["image"])
                h, w = a.shape[:2]
                rgb = np.stack([a] * 3, -1) if a.ndim == 2 else a[..., :3]
                x = masks.normalized_square(raster.resize(rgb.astype(np.float64), masks.longest_side(h, w, side)), side, mean, std).transpose(2, 0, 1)[None].astype(np.float32)
                out = encoder(x)
                yield pa.RecordBatch.from_pylist([{"image_id": row["image_id"], "height": h, "width": w, "embedding": pack(out.transpose(1, 2, 0) if out.shape[0] > 1 else out[0])}], arrow)

    return written(images.select("image_id", "image").mapInArrow(run, schema))


def predicted(embeddings: DataFrame, prompts: DataFrame, decoder: Decoder, side: int = 1024, multimask: bool = True, batch: int = 64, threshold: float = 0.0) -> DataFrame:
    """(image_id, prompt_id, k, iou, mask) for the tokens of each prompt: masks 1 to 3 with multimask, else mask 0, at the image's size."""
    counts = prompts.groupBy("image_id", F.size("tokens").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n"))
    dealt = prompts.withColumn("n_tokens", F.size("tokens")).join(counts, ["image_id", "n_tokens"]).withColumn("batch", F.pmod(F.xxhash64("prompt_id"), F.ceil(F.col("n") / batch)))
    dealt = dealt.select("image_id", "n_tokens", "batch", "prompt_id", "tokens")
    wanted = embeddings.join(counts, "image_id").withColumn("batch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / batch) - 1))).drop("n")
    schema = StructType([prompts.schema["image_id"], prompts.schema["prompt_id"], *StructType.fromDDL("k int, iou double").fields, StructField("mask", RASTER)])
    arrow = to_arrow_schema(schema)
    which = range(1, 4) if multimask else range(1)

    def run(asked: pa.Table, of: pa.Table) -> pa.Table:
        if not asked.num_rows or not of.num_rows:
            return pa.Table.from_pylist([], arrow)
        image = of.to_pylist()[0]
        h, w = image["height"], image["width"]
        embedding = unpack(image["embedding"])
        rows = asked.to_pylist()
        logits, ious = decoder(embedding[None] if embedding.ndim == 2 else embedding.transpose(2, 0, 1), np.array([r["tokens"] for r in rows], np.float64))
        inner = masks.longest_side(h, w, side)
        out = [{"image_id": r["image_id"], "prompt_id": r["prompt_id"], "k": k, "iou": float(ious[i, k]), "mask": pack(masks.restore_logits(logits[i, k][None], side, inner, (h, w))[0] > threshold)} for i, r in enumerate(rows) for k in which]
        return pa.Table.from_pylist(out, arrow)

    keys = ["image_id", "n_tokens", "batch"]
    return dealt.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(run, schema)
