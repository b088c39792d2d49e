"""Schemas of the tables (section 1)."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .functions.texture import FEATURES

RASTER = StructType([StructField("h", IntegerType()), StructField("w", IntegerType()), StructField("c", IntegerType()), StructField("dtype", StringType()), StructField("data", BinaryType())])
MANIFEST = StructType([StructField(n, StringType(), n.startswith("path")) for n in ("sample_id", "parent_id", "algorithm", "path_phase", "path_actin", "path_mt", "path_nuc")])
FEATURE_ROW = StructType([StructField(n, StringType()) for n in ("sample_id", "parent_id", "algorithm")] + [StructField(n, DoubleType()) for n in FEATURES])
QC_ROW = StructType([StructField("filename", StringType()), StructField("passes", BooleanType()), StructField("edge_density", DoubleType()), StructField("nucleus_area", DoubleType()), StructField("nucleus_num_components", IntegerType()), StructField("cell_area", DoubleType()), StructField("cell_num_components", IntegerType()), StructField("reasons", StringType())])
RLE = StructType([StructField("size", ArrayType(IntegerType())), StructField("counts", ArrayType(IntegerType()))])
ANNOTATION = StructType([StructField("image_id", StringType()), StructField("segmentation", RLE), StructField("area", LongType()), StructField("bbox", ArrayType(DoubleType())), StructField("predicted_iou", DoubleType()), StructField("stability_score", DoubleType()), StructField("crop_box", ArrayType(DoubleType())), StructField("point_coords", ArrayType(ArrayType(DoubleType())))])
