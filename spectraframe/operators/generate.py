"""Variant generation (G1 to G11): parameters are columns, made from keyed hashes; kernels apply them in Arrow batches.

A variant's random numbers come from its sample_id and the seed alone, so a task that runs again makes the same images and
variants can be made anywhere. All channels of a sample share its fields; only the noise is per channel, if so configured.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import CHANNELS, Config
from ..functions import raster
from ..schemas import RASTER
from ..sources.images import few, pack, unpack


def uniform(key: Column, name: str, seed: int, low: float, high: float) -> Column:
    """A number in [low, high) from a row's key."""
    return F.lit(low) + F.pmod(F.xxhash64(key, F.lit(name), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30) * (high - low)


def numbered(cells: DataFrame, algorithm: str, n: int) -> DataFrame:
    """Cells (cell_id) times 1 to n: (sample_id, parent_id, algorithm, k)."""
    rows = cells.select(F.col("cell_id").alias("parent_id"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    return rows.select(F.concat("parent_id", F.lit(f"_{algorithm}_"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("sample_id"), "parent_id", F.lit(algorithm).alias("algorithm"), "k")


def manifest(cells: DataFrame, n: int, folder: str) -> DataFrame:
    """Rows of originals and of n variants of both algorithms, without making images."""
    originals = cells.select(F.concat("cell_id", F.lit("_original")).alias("sample_id"), F.col("cell_id").alias("parent_id"), F.lit("original").alias("algorithm"))
    rows = originals
    for algorithm in ("alg1", "alg2"):
        rows = rows.unionByName(numbered(cells, algorithm, n).drop("k"))
    part = F.when(F.col("algorithm") == "original", "originals").otherwise(F.col("algorithm"))
    return rows.select("*", *[F.concat(F.lit(f"{folder}/"), part, F.lit("/"), F.col("sample_id"), F.lit(f"_{c}.png")).alias(f"path_{c}") for c in CHANNELS])


def with_parameters(samples: DataFrame, config: Config) -> DataFrame:
    """The parameters of algorithm 1 for each sample."""
    key = F.col("sample_id")

    def u(name: str, low: float, high: float) -> Column:
        return uniform(key, name, config.seed, low, high)

    return samples.withColumns({"angle": u("angle", *config.rotation), "flip_lr": u("lr", 0, 1) < 0.5, "flip_ud": u("ud", 0, 1) < 0.5, "elastic": u("elastic", 0, 1) < 0.7, "noise": u("noise", 0, config.noise_std), "brightness": u("brightness", *config.brightness), "contrast": u("contrast", *config.contrast), "zoom": u("zoom", *config.zoom)})


def _generator(sample_id: str, seed: int, use: str) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(f"{sample_id}/{use}".encode())])


def classical(a: np.ndarray, p: object, channel: str, config: Config) -> np.ndarray:
    """Rotation, flips, elastic, noise, brightness and contrast, zoom, in that order."""
    a = raster.flip(raster.rotate(a, p.angle), p.flip_lr, p.flip_ud)
    if p.elastic:
        a = raster.elastic(a, _generator(p.sample_id, config.seed, "elastic"), config.elastic_alpha, config.elastic_sigma)
    a = raster.noise(a, _generator(p.sample_id, config.seed, f"noise/{channel}" if config.per_channel_noise else "noise"), p.noise)
    return np.clip(raster.zoom(raster.brightness_contrast(a, p.brightness, p.contrast), p.zoom), 0, 1)


def structural(a: np.ndarray, p: object, channel: str, config: Config) -> np.ndarray:
    """One warp for all channels of a sample: piecewise affine, or a spline if so configured."""
    source, target = raster.control_points(a.shape, _generator(p.sample_id, config.seed, "warp"), config.control_points, config.displacement)
    warp = {"piecewise": raster.piecewise_affine_warp, "spline": raster.thin_plate_warp}[config.warp]
    return np.clip(warp(a, source, target), 0, 1)


def variants(cells: DataFrame, algorithm: str, config: Config = Config()) -> DataFrame:
    """G7, G10 over (cell_id, phase, actin, mt, nuc): n_per_cell rows a cell: (sample_id, parent_id, algorithm, channels, error)."""
    samples = with_parameters(numbered(cells.select("cell_id"), algorithm, config.n_per_cell), config)
    rows = samples.join(cells.withColumnRenamed("cell_id", "parent_id"), "parent_id")
    kernel = {"alg1": classical, "alg2": structural}[algorithm]
    schema = StructType([*[StructField(n, StringType()) for n in ("sample_id", "parent_id", "algorithm")], *[StructField(c, RASTER) for c in CHANNELS], StructField("error", StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in few(batches):
            out = []
            for p in pdf.itertuples(index=False):
                images, error = dict.fromkeys(CHANNELS), None
                try:
                    found = {c: a for c in CHANNELS if (x := getattr(p, c)) is not None and (a := unpack(x if isinstance(x, dict) else x.asDict())) is not None}
                    if len({a.shape for a in found.values()}) > 1:
                        raise ValueError("channels of different shapes")
                    images |= {c: pack(kernel(raster.to_float(a).astype(np.float64), p, c, config).astype(np.float32)) for c, a in found.items()}
                except Exception as e:  # the row keeps the reason
                    error = f"{type(e).__name__}: {e}"
                out.append((p.sample_id, p.parent_id, p.algorithm, *images.values(), error))
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return rows.mapInPandas(run, schema)


def seeded_order(df: DataFrame, key: str, seed: int) -> Column:
    """L2: a shuffle that any engine repeats: the order of md5(key, seed)."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """L2, L4: the first n of a seeded shuffle (a top-n, not a full sort)."""
    return df.orderBy(seeded_order(df, key, seed), key).limit(n)


def pick_channel(key: Column, present: Column, seed: int) -> Column:
    """L3: one of the channels that are there, the first in a seeded order of the key's own; null if none."""
    keyed = F.transform(present, lambda c: F.struct(F.md5(F.concat(key.cast("string"), F.lit("/"), c, F.lit(f":{seed}"))).alias("h"), c.alias("channel")))
    return F.array_min(keyed)["channel"]


def beta_schedule(spark, steps: int = 1000, first: float = 0.0001, last: float = 0.02) -> DataFrame:
    """(t, beta, alpha, alpha_bar). As long as the schedule, so one task's window."""
    from pyspark.sql import Window

    t = spark.range(steps).select(F.col("id").cast("int").alias("t"))
    beta = F.lit(first) + F.col("t") * ((last - first) / max(1, steps - 1))
    return t.withColumns({"beta": beta, "alpha": 1 - beta}).withColumn("alpha_bar", F.exp(F.sum(F.log("alpha")).over(Window.orderBy("t"))))


def forward_noise(x: Column, alpha_bar: Column, epsilon: Column) -> Column:
    """N2."""
    return F.sqrt(alpha_bar) * x + F.sqrt(1 - alpha_bar) * epsilon


def timestep_embedding(t: Column, dim: int) -> Column:
    """Sines, then cosines, of t over dim / 2 geometric frequencies."""
    half = dim // 2
    freq = [float(np.exp(-np.log(10000.0) * k / max(1, half - 1))) for k in range(half)]
    return F.array(*[F.sin(t * f) for f in freq], *[F.cos(t * f) for f in freq])
