"""Functions for SQL text (section 2.13): registered on a session by name, with views over a folder of tables."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import masks

#: SQL expressions as functions: name, arguments, result, body. Catalyst inlines them.
EXPRESSIONS = {
    "nc_ratio": ("cell DOUBLE, nucleus DOUBLE", "DOUBLE", "CASE WHEN cell - nucleus <= 1e-6 THEN 0D ELSE nucleus / (cell - nucleus) END"),
    "circularity": ("area DOUBLE, perimeter DOUBLE", "DOUBLE", "4 * pi() * area / (perimeter * perimeter + 1e-6)"),
    "luminance": ("r DOUBLE, g DOUBLE, b DOUBLE", "DOUBLE", "0.299D * r + 0.587D * g + 0.114D * b"),
    "to_byte": ("v DOUBLE", "INT", "CAST(floor(greatest(0D, least(1D, v)) * 255) AS INT)"),
    "clip01": ("v DOUBLE", "DOUBLE", "greatest(0D, least(1D, v))"),
    "box_area": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", "DOUBLE", "greatest(0D, x1 - x0) * greatest(0D, y1 - y0)"),
    "rle_area": ("counts ARRAY<INT>", "BIGINT", "aggregate(filter(counts, (x, i) -> i % 2 = 1), 0L, (a, x) -> a + x)"),
    "is_original": ("sample_id STRING", "BOOLEAN", "contains(lower(sample_id), 'original')"),
    "longest_side_scale": ("h INT, w INT, target INT", "ARRAY<INT>", "array(CAST(floor(h * target / greatest(h, w) + 0.5) AS INT), CAST(floor(w * target / greatest(h, w) + 0.5) AS INT))"),
    "per_cent": ("x DOUBLE", "STRING", "concat(format_string('%.1f', x * 100), '%')"),
}


def register(spark: SparkSession) -> list[str]:
    """The expressions, and mask_to_rle(array<boolean>, width) as an Arrow function."""
    for name, (arguments, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")

    @F.pandas_udf(ArrayType(IntegerType()))
    def mask_to_rle(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import numpy as np

        for px, width in batches:
            yield pd.Series([masks.encode(np.array(m, bool).reshape(-1, w)) for m, w in zip(px, width, strict=True)])

    spark.udf.register("mask_to_rle", mask_to_rle)
    return [*EXPRESSIONS, "mask_to_rle"]


def views(spark: SparkSession, folder: str) -> list[str]:
    """A temporary view of each Parquet table in a local folder."""
    names = sorted(p.name.removesuffix(".parquet") for p in Path(folder).glob("*.parquet"))
    for name in names:
        spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)
    return names
