"""Suppression of overlapping boxes (J11, X15) in images of any number of boxes.

The plane is cut into blocks, a few boxes wide; a box is filed in each block that it reaches into. Round by round, a task goes through a block's
best boxes in their order: a box goes if one that surely stays ranks higher and overlaps it; it stays as far as this block can tell if none
that may stay does. A box that lies in one block is then settled, others when all their blocks agree. Only what ranks higher
can matter to a box, so a block of any size is done in parts of `MOST` boxes, the best first, which Spark cuts off before it shuffles.

What overlaps a box that has just been found to stay goes at once: boxes are filed in grids for that, whose cells are as large as the boxes of a
level (a power of two in either direction) and at as many levels above as two boxes can differ that overlap by more than the
threshold. The result is that of going through all boxes of an image one by one. Images of a few boxes are done so, in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks
from .tables import discard, written

SMALL = 4096  # boxes of an image that are done in one task
MOST = 2048  # boxes of a block that are done in a round
BLOCK_SIDES = 8  # a block's side in sides of a usual box
CLEAR, UNKNOWN, GONE = range(3)


def iou(a: Column, b: Column) -> Column:
    """Of two boxes (x0, y0, x1, y1)."""
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(zero, F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    size = [(x["x1"] - x["x0"]) * (x["y1"] - x["y0"]) for x in (a, b)]
    return F.coalesce(both / F.nullif(size[0] + size[1] - both, zero), zero)


def _filed(rows: DataFrame, above: tuple[int, int], top: tuple[int, int]) -> DataFrame:
    """rows, once for each cell that they are filed in."""
    for k, axis in enumerate("xy"):
        level = F.explode(F.sequence(F.col(f"l{axis}"), F.least(F.col(f"l{axis}") + above[k], F.lit(top[k]))))
        rows = rows.withColumn(f"j{axis}", level)
        size = F.pow(F.lit(2.0), F.col(f"j{axis}"))
        rows = rows.withColumn(f"c{axis}", F.explode(F.sequence(F.floor(F.col(f"box.{axis}0") / size), F.floor(F.col(f"box.{axis}1") / size))))
    return rows.drop("lx", "ly")


_CELL = ["image_id", "jx", "jy", "cx", "cy"]
_BLOCK = ["image_id", "bx", "by"]


def _judged(left: DataFrame, side: float, threshold: float) -> DataFrame:
    """(uid, gone) of boxes that a round settles; left: (image_id, uid, box, rank, n_blocks)."""
    for axis in "xy":
        left = left.withColumn(f"b{axis}", F.explode(F.sequence(F.floor(F.col(f"box.{axis}0") / side), F.floor(F.col(f"box.{axis}1") / side))))
    order = F.row_number().over(Window.partitionBy(*_BLOCK).orderBy(F.desc("rank")))
    best = left.withColumn("k", order).where(F.col("k") <= MOST)

    def judge(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        at = np.array([[b[c] for c in ("x0", "y0", "x1", "y1")] for b in table.column("box").to_pylist()], float)
        inside = table.column("n_blocks").to_numpy() == 1
        kept, open_, verdict = np.zeros(len(at), bool), np.zeros(len(at), bool), np.zeros(len(at), np.int32)
        for i in range(len(at)):
            before = np.flatnonzero(kept[:i] | open_[:i])
            over = before[masks.iou(at[i : i + 1], at[before])[0] > threshold]
            if kept[over].any():
                verdict[i] = GONE
            else:
                verdict[i] = UNKNOWN if len(over) else CLEAR
                kept[i] = inside[i] and not len(over)
                open_[i] = not kept[i]
        return pa.table({"uid": table.column("uid"), "n_blocks": table.column("n_blocks"), "verdict": verdict})

    found = best.select(*_BLOCK, "uid", "box", "k", "n_blocks").groupBy(*_BLOCK).applyInArrow(judge, "uid long, n_blocks long, verdict int")
    each = found.groupBy("uid", "n_blocks").agg(F.count_if(F.col("verdict") == CLEAR).alias("clear"), F.count_if(F.col("verdict") == GONE).alias("gone"))
    return each.where((F.col("gone") > 0) | (F.col("clear") == F.col("n_blocks"))).select("uid", (F.col("gone") > 0).alias("gone"))


def _by_grid(boxes: DataFrame, threshold: float) -> DataFrame:
    sides = {axis: F.col(f"box.{axis}1") - F.col(f"box.{axis}0") for axis in "xy"}
    rows = written(boxes.withColumn("uid", F.monotonically_increasing_id()))
    flat = F.coalesce(F.least(*sides.values()) <= 0, F.lit(True))
    if threshold >= 1:
        return rows.drop("uid")
    levels = {f"l{axis}": F.ceil(F.log2(side)).cast("int") for axis, side in sides.items()}
    open_ = rows.where(~flat).withColumns(levels).select("image_id", "uid", "box", F.struct("score", (-F.col("id")).alias("id"), (-F.col("uid")).alias("uid")).alias("rank"), "lx", "ly")
    w, h = sides.values()
    least = open_.agg(*[f(c) for c in ("lx", "ly") for f in (F.min, F.max)], F.sqrt(F.avg(w * h)), F.avg(w), F.avg(h)).first()
    kept = rows.where(flat).select("uid")
    if least[0] is not None:
        span, top = (least[1] - least[0], least[3] - least[2]), (least[1], least[3])
        reach = math.ceil(math.log2(1 / threshold)) if threshold > 0 else max(span)
        above = min(reach, span[0]), min(reach, span[1])
        side = BLOCK_SIDES * max(least[4:])
        blocks = [F.floor(F.col(f"box.{axis}1") / side) - F.floor(F.col(f"box.{axis}0") / side) + 1 for axis in "xy"]
        left = written(open_.withColumn("n_blocks", blocks[0] * blocks[1]))
        while left.take(1):
            settled = written(_judged(left.drop("lx", "ly"), side, threshold))
            stays = written(left.join(settled.where("NOT gone").select("uid"), "uid", "left_semi"))
            others = _filed(left.join(settled.select("uid"), "uid", "left_anti").select("image_id", "uid", "box", "lx", "ly"), above, top)
            over = _filed(stays.select("image_id", F.col("box").alias("over"), "box", "lx", "ly"), above, top).drop("box")
            gone = others.join(over, _CELL).where(iou(F.col("over"), F.col("box")) > threshold).select("uid").union(settled.select("uid")).distinct()
            old, left = left, written(left.join(gone, "uid", "left_anti"))
            kept = kept.union(stays.select("uid"))
            discard(old, settled)
        discard(left)
    return rows.join(kept, "uid", "left_semi").drop("uid")


def _one_by_one(boxes: DataFrame, threshold: float) -> DataFrame:
    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        at = np.array([[b[k] for k in ("x0", "y0", "x1", "y1")] for b in pdf["box"]], float)
        return pdf.iloc[masks.nms(at, pdf["score"].to_numpy(), threshold)]

    return boxes.groupBy("image_id").applyInPandas(keep, boxes.schema)


def suppressed(boxes: DataFrame, threshold: float, small: int = SMALL) -> DataFrame:
    """J11, X15 over (image_id, id, box, score): the rows that suppression keeps, by score and then id; images of more than `small` boxes
    by grids. Boxes of no area overlap nothing."""
    rows = written(boxes)
    large = rows.groupBy("image_id").count().where(F.col("count") > small).select("image_id")
    if not large.take(1):
        return _one_by_one(rows, threshold)
    of_large = rows.join(large, "image_id", "left_semi")
    if not small:
        return _by_grid(of_large, threshold)
    return _one_by_one(rows.join(large, "image_id", "left_anti"), threshold).unionByName(_by_grid(of_large, threshold))
