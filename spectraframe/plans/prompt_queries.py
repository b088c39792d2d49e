"""Queries of prompts: encodings, and masks from embeddings that are made once, on the rasters of the embeddings table."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prompts
from ..schemas import RASTER
from .queries import PX, images, packed, query, rounded

WIDTH = 4  # frequencies; a token has twice as many numbers
H, W = 96, 128


def _made(k: int) -> list[float]:
    """A vector of a token's width, different for each k."""
    return [round(math.sin(1.0 + j + 3 * k), 3) for j in range(2 * WIDTH)]


WEIGHTS = prompts.Weights([_made(7)[:WIDTH], _made(8)[:WIDTH]], *(_made(k) for k in range(5)))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each raster's prompt: three points from its first values, labelled 1, 0 and -1, for two of three rasters; a box for one of two."""
    v = [F.get("px", k) for k in range(10)]
    points = F.array(*[F.struct((64 + 40 * v[2 * k]).alias("x"), (48 + 30 * v[2 * k + 1]).alias("y"), F.lit(1 - k).alias("label")) for k in range(3)])
    box = F.struct(*[(20 + 10 * k + v[6 + k]).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))])
    i = F.col("vec_id")
    return images(spark, sf_dir).where((i % 3 > 0) | (i % 2 == 0)).select(i.alias("image_id"), (i * 10).alias("prompt_id"), F.when(i % 3 > 0, points).alias("points"), F.when(i % 2 == 0, box).alias("box"))


def _values(name: str, vectors: list[list[float]]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join(f'({k}, {j}, {x})' for k, vector in enumerate(vectors) for j, x in enumerate(vector))}) t(kind, j, w))"


TOKENS = f"""WITH {PX}, {_values("add_", [WEIGHTS.not_a_point, WEIGHTS.background, WEIGHTS.foreground, WEIGHTS.low_corner, WEIGHTS.high_corner])}, {_values("freq", WEIGHTS.matrix)},
e AS (SELECT vec_id AS i, list(v ORDER BY pos) AS v FROM p GROUP BY vec_id),
s AS (SELECT i, k AS n, 64 + 40 * v[2 * k + 1] AS x, 48 + 30 * v[2 * k + 2] AS y, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS kind FROM e, range(3) r(k) WHERE i % 3 > 0
  UNION ALL SELECT i, 3, 0, 0, 0 FROM e WHERE i % 3 > 0 AND i % 2 = 1
  UNION ALL SELECT i, CASE WHEN i % 3 > 0 THEN 3 ELSE 0 END + c, CASE c WHEN 0 THEN 20 + v[7] ELSE 40 + v[9] END, CASE c WHEN 0 THEN 30 + v[8] ELSE 50 + v[10] END, 3 + c FROM e, range(2) r(c) WHERE i % 2 = 0),
g AS (SELECT a.j, a.w AS wx, b.w AS wy FROM freq a JOIN freq b ON a.j = b.j WHERE a.kind = 0 AND b.kind = 1),
o AS (SELECT i, n, kind, g.j, 2 * pi() * ((2 * (x + 0.5) / {W} - 1) * wx + (2 * (y + 0.5) / {H} - 1) * wy) AS t FROM s, g),
f AS (SELECT i, n, kind, j, sin(t) AS v FROM o UNION ALL SELECT i, n, kind, j + {WIDTH}, cos(t) FROM o),
t AS (SELECT f.i, f.n, f.j, CASE WHEN f.kind = 0 THEN 0 ELSE f.v END + a.w AS v FROM f JOIN add_ a ON a.kind = f.kind AND a.j = f.j)
"""


@query(TOKENS + "SELECT i AS image_id, CAST(n AS INT) AS n, CAST(j AS INT) AS j, round(v, 5) + 0.0 AS v FROM t")
def prompt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodings of labelled points and boxes, as columns."""
    tokens = prompts.encoded(asked(spark, sf_dir), H, W, WEIGHTS)
    each = tokens.select("image_id", F.posexplode("tokens").alias("n", "token"))
    return rounded(each.select("image_id", "n", F.posexplode("token").alias("j", "v")))


def _embedding(x: np.ndarray) -> np.ndarray:
    return x[0].mean(0, keepdims=True)


def _logits(embedding: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four masks: the embedding against the mean of the prompt's tokens, each a little lower."""
    level = np.round(tokens.mean((1, 2)), 5)
    steps = np.arange(4) / 8
    return embedding[0][None, None] - 0.2 * level[:, None, None, None] - steps[None, :, None, None] + 0.2, level[:, None] + steps


@query(TOKENS + ", m AS (SELECT i, round(avg(v), 5) AS m FROM t GROUP BY i) SELECT p.vec_id AS image_id, p.vec_id * 10 AS prompt_id, CAST(k AS INT) AS k, round(any_value(m.m) + k / 8.0, 5) + 0.0 AS iou, count(*) FILTER (WHERE v - 0.2 * m.m - k / 8.0 + 0.2 > 1e-9) AS area FROM p JOIN m ON m.i = p.vec_id, range(1, 4) r(k) GROUP BY p.vec_id, k")
def prompted_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image embedded once; its prompts' three masks."""
    rows = images(spark, sf_dir).select("vec_id", "px").mapInPandas(lambda b: packed(b, "px"), f"image_id long, image {RASTER.simpleString()}")
    embeddings = prompts.embedded(rows, _embedding, 8, (0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    found = prompts.predicted(embeddings, prompts.encoded(asked(spark, sf_dir), H, W, WEIGHTS), _logits, 8, threshold=1e-9)
    area = F.length(F.replace(F.hex("mask.data"), F.lit("00"), F.lit(""))) / 2  # a byte a pixel
    return rounded(found.select("image_id", "prompt_id", "k", "iou", area.cast("long").alias("area")))
