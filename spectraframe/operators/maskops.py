"""Mask tables: grids, crops, filters, and automatic mask generation around any predictor (section 2.12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masks, regions
from ..schemas import ANNOTATION
from ..sources.images import few, unpack
from .suppression import iou, suppressed


def point_grid(spark: SparkSession, n: int) -> DataFrame:
    """(k, x, y)."""
    at = [(F.col("id") % n + 0.5) / n, (F.floor(F.col("id") / n) + 0.5) / n]
    return spark.range(n * n).select(F.col("id").cast("int").alias("k"), at[0].alias("x"), at[1].alias("y"))


def crop_boxes(spark: SparkSession, h: int, w: int, layers: int, overlap: float) -> DataFrame:
    """X11: (layer, i, j, x0, y0, x1, y1)."""
    rows = spark.range(layers + 1).select(F.col("id").cast("int").alias("layer"), F.pow(F.lit(2), F.col("id")).cast("int").alias("n"))
    rows = rows.withColumn("ov", F.when(F.col("layer") == 0, 0).otherwise(F.floor(F.lit(overlap) * min(h, w) * 2 / F.col("n")))).withColumns({"bw": F.ceil((F.col("ov") * (F.col("n") - 1) + w) / F.col("n")), "bh": F.ceil((F.col("ov") * (F.col("n") - 1) + h) / F.col("n"))})
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumns({"x0": (F.col("bw") - F.col("ov")) * F.col("i"), "y0": (F.col("bh") - F.col("ov")) * F.col("j")})
    return rows.select("layer", "i", "j", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0")], F.least(F.col("x0") + F.col("bw"), F.lit(w)).cast("int").alias("x1"), F.least(F.col("y0") + F.col("bh"), F.lit(h)).cast("int").alias("y1"))


def near_crop_edge(box: Column, crop: list[int], image: list[int], atol: float = 20) -> Column:
    """F12 for a struct (x0, y0, x1, y1) in crop coordinates."""
    out = F.lit(False)
    for k, name in enumerate(("x0", "y0", "x1", "y1")):
        side = box[name] + crop[k % 2]
        out = out | ((F.abs(side - crop[k]) <= atol) & ~(F.abs(side - image[k]) <= atol))
    return out


__all__ = ["iou", "suppressed"]  # the operators of `suppression` belong here, too

#: What segments: (image, points (x, y)) to logits (n, 3, h, w) and predicted ious (n, 3).
Predictor = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


TOLERANCES = np.array([0.05, 0.1, 0.2])
PIXELS = 1 << 20  # of the masks that are made at a time


def intensity_predictor(image: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stand-in for a trained model: pixels as bright as the point's, at three tolerances, connected to it."""
    g = image if image.ndim == 2 else image[..., :3].mean(-1)
    g = g.astype(float) / max(1.0, float(g.max()))
    cols, rows = points.astype(int).T
    logits, ious = np.empty((len(points), 3, *g.shape)), np.tile(1 - TOLERANCES, (len(points), 1))
    some = max(1, PIXELS // (3 * g.size))
    for k in range(0, len(points), some):
        r, c = rows[k : k + some], cols[k : k + some]
        near = np.abs(g - g[r, c][:, None, None])[:, None] <= TOLERANCES[:, None, None]
        on = regions.holding(near.reshape(-1, *g.shape), np.repeat(r, 3), np.repeat(c, 3))
        logits[k : k + some] = np.where(on, 4.0, -4.0).reshape(-1, 3, *g.shape)
    return logits, ious


def automatic_masks(images: DataFrame, predictor: Predictor = intensity_predictor, points_per_side: int = 32, batch: int = 64, iou_least: float = 0.88, stability_least: float = 0.95, offset: float = 1.0, box_nms: float = 0.7, layers: int = 0, crop_nms: float = 0.7, overlap: float = 512 / 1500, scale: int = 1, min_region: int = 0) -> DataFrame:
    """Annotations of each (image_id, image): points on a grid in each crop, in batches; masks of enough predicted
    iou and stability, not cut off by a crop; suppression within and across crops (small crops first); small holes and
    islands removed if asked. predictor: a trained model's session in a closure."""

    def of(image_id: str, image: np.ndarray) -> list[tuple]:
        h, w = image.shape[:2]
        found: list[dict] = []
        grids = masks.layer_grids(points_per_side, layers, scale)
        for crop, layer in masks.crop_boxes((h, w), layers, overlap):
            x0, y0, x1, y1 = crop
            part = image[y0:y1, x0:x1]
            points, own = grids[layer] * [x1 - x0, y1 - y0], []
            for lo in range(0, len(points), batch):  # X19
                some = points[lo : lo + batch]
                logits, ious = predictor(part, some)
                for k, m in np.argwhere(ious > iou_least):
                    s = masks.stability(logits[k, m], 0.0, offset)
                    on = logits[k, m] > 0
                    box = masks.box(on)
                    if s >= stability_least and not masks.near_crop_edge(np.array([box]), crop, [0, 0, w, h])[0]:
                        full = np.zeros((h, w), bool)
                        full[y0:y1, x0:x1] = on
                        own.append({"rle": masks.encode(full), "box": [box[0] + x0, box[1] + y0, box[2] + x0, box[3] + y0], "iou": float(ious[k, m]), "stability": s, "point": [float(some[k][0] + x0), float(some[k][1] + y0)], "crop": crop})
            found += [own[i] for i in masks.nms(np.array([o["box"] for o in own]), np.array([o["iou"] for o in own]), box_nms)] if own else []
        if layers and found:
            small = np.array([1 / ((o["crop"][2] - o["crop"][0]) * (o["crop"][3] - o["crop"][1])) for o in found])
            found = [found[i] for i in masks.nms(np.array([o["box"] for o in found]), small, crop_nms)]
        if min_region and found:
            same = []
            for o in found:
                on, a = regions.remove_small_regions(masks.decode((h, w), o["rle"]), min_region, "holes")
                on, b = regions.remove_small_regions(on, min_region, "islands")
                same.append(float(not (a or b)))
                if a or b:
                    o["rle"], o["box"] = masks.encode(on), masks.box(on)
            found = [found[i] for i in masks.nms(np.array([o["box"] for o in found]), np.array(same), max(box_nms, crop_nms))]
        return [(image_id, {"size": [h, w], "counts": o["rle"]}, masks.area(o["rle"]), [float(v) for v in masks.xywh(o["box"])], o["iou"], o["stability"], [float(v) for v in masks.xywh(o["crop"])], [o["point"]]) for o in found]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few(batches):
            rows = [r for i, x in zip(pdf["image_id"], pdf["image"], strict=True) for r in of(i, unpack(x if isinstance(x, dict) else x.asDict()))]
            yield pd.DataFrame(rows, columns=ANNOTATION.fieldNames())

    return images.select("image_id", "image").mapInPandas(run, ANNOTATION)


def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; a column that one lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def by_index(df: DataFrame, index: str, wanted: list[int]) -> DataFrame:
    """the rows with the wanted indices, in that order (`position`)."""
    order = df.sparkSession.createDataFrame([(k, i) for k, i in enumerate(wanted)], f"position int, {index} long")
    return df.join(F.broadcast(order), index)  # as long as the argument


def onnx_predictor(path: str, side: int = 1024, mean: tuple[float, float, float] = (123.675, 116.28, 103.53), std: tuple[float, float, float] = (58.395, 57.12, 57.375)) -> Predictor:
    """A predictor around an exported model that takes `image` (1, 3, side, side), `point_coords` (n, 1, 2) and
    `point_labels` (n, 1) and gives low-resolution logits and ious. Each worker opens the file once; on a cluster name one
    that SparkContext.addFile has sent. No weights are at hand here, so only the interface is tested."""
    sessions: dict[str, object] = {}

    def predict(image: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        from ..functions import raster

        if path not in sessions:
            import onnxruntime

            sessions[path] = onnxruntime.InferenceSession(path)
        h, w = image.shape[:2]
        inner = masks.longest_side(h, w, side)
        rgb = np.stack([image] * 3, -1) if image.ndim == 2 else image[..., :3]
        x = masks.normalized_square(raster.resize(rgb.astype(np.float64), inner), side, mean, std).transpose(2, 0, 1)[None].astype(np.float32)
        at = masks.scale_points(points, (h, w), side).astype(np.float32)[:, None]
        logits, ious = sessions[path].run(None, {"image": x, "point_coords": at, "point_labels": np.ones(at.shape[:2], np.float32)})  # type: ignore[attr-defined]
        return np.stack([masks.restore_logits(m, side, inner, (h, w)) for m in logits]), ious

    return predict
