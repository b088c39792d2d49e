"""Scans and sinks of image folders, manifests and result tables (section 2.1).

Files are listed by Spark's binaryFile source, and those chosen are opened by tasks (PNG, JPEG or TIFF, `functions.formats`);
`rasters` has a data source of its own, with conditions in the listing and a commit.
Rasters travel as a struct of shape, type and bytes. Files are written by tasks, to paths that their row determines, so a
task that runs again writes the same files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..config import EXTENSIONS, PREFIXES, SIZE_ORDER, SUFFIXES
from ..functions import formats, png, raster
from ..operators.tables import discard, written
from ..schemas import MANIFEST, QC_ROW, RASTER
from .rasters import PARTITION_BYTES, pack, read_image, store, unpack

READ_ROWS = 32  # images of an Arrow batch


def few(batches: Iterator[pd.DataFrame], rows: int = READ_ROWS) -> Iterator[pd.DataFrame]:
    """The batches in parts of some rows, so that what a kernel makes of a part, which can be many times as large, is sent on before the next."""
    for pdf in batches:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k : k + rows]


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths under a folder; the files' bytes are not read."""
    return _sized(spark, root, pattern).select("path")


def _sized(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "length")


def _with_images(files: DataFrame, drop: str | None, of: Callable[[object], tuple[dict | None, str | None]]) -> DataFrame:
    source = drop or "path"
    schema = StructType([*[f for f in files.schema.fields if f.name != drop], StructField("image", RASTER), StructField("error", StringType())])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, READ_ROWS):
                part = batch.slice(k, READ_ROWS)
                found = [of(x.as_py()) for x in part.column(source)]
                columns = [c for c, name in zip(part.columns, part.schema.names, strict=True) if name != drop]
                images = pa.array([image for image, _ in found], arrow.field("image").type)
                yield pa.RecordBatch.from_arrays([*columns, images, pa.array([error for _, error in found], pa.string())], schema=pa.schema([*(f.with_type(c.type) for f, c in zip(list(arrow)[:-2], columns, strict=True)), *list(arrow)[-2:]]))

    return files.mapInArrow(read, schema)


def decoded(files: DataFrame) -> DataFrame:
    """files (with path, content) and `image`; a file that can't be read has null, and its reason in `error`."""

    def of(content: bytes) -> tuple[dict | None, str | None]:
        try:
            return pack(formats.decode(content)), None
        except Exception as e:  # the row keeps the reason
            return None, f"{type(e).__name__}: {e}"

    return _with_images(files, "content", of)


def opened(files: DataFrame) -> DataFrame:
    """files (with path) and `image`, `error`: each task opens the paths of its own rows, so no other file's bytes are read."""
    return _with_images(files, None, read_image)


def spread(files: DataFrame) -> DataFrame:
    """files (with path, length), dealt into partitions of some PARTITION_BYTES of what the files hold, and one a core at least: the rows
    themselves are small, and Spark would put them together."""
    total = files.agg(F.sum("length")).first()[0] or 0
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, -(-total // PARTITION_BYTES)), "path")


def resolve_channels(spark: SparkSession, root: str, cells: list[str] | None = None, channels: tuple[str, ...] = ("phase", "actin", "mt", "nuc"), channel_map: dict[str, str] | None = None) -> DataFrame:
    """(cell_id, channel, path, length): by extension in order, then the mapped prefix before the cell's own; the first wins. A
    channel without a file raises FileNotFoundError. channel_map: other channels, by the last part of their files' names."""
    ext = F.array(*map(F.lit, EXTENSIONS))
    suffixes = SUFFIXES if channel_map is None else channel_map
    channels = channels if channel_map is None else tuple(channel_map)
    part = r"/([^/]+)/([^/]+)_([^/_]+)(\.[A-Za-z]+)$"
    rows = _sized(spark, root).select("path", "length", *[F.regexp_extract("path", part, k).alias(n) for k, n in enumerate(("cell_id", "prefix", "suffix", "ext"), 1)])
    names = F.create_map(*[F.lit(x) for k, v in suffixes.items() for x in (v, k)])
    mapped = F.coalesce(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])[F.col("cell_id")], F.col("cell_id"))
    rows = rows.withColumns({"channel": names[F.col("suffix")], "e": F.array_position(ext, F.lower("ext"))}).where("channel IS NOT NULL AND e > 0")
    rows = rows.where((F.col("prefix") == mapped) | (F.col("prefix") == F.col("cell_id"))).where(F.col("channel").isin(*channels))
    if cells is not None:
        rows = rows.where(F.col("cell_id").isin(*cells))
    found = rows.groupBy("cell_id", "channel").agg(F.min_by(F.struct("path", "length"), F.struct("e", F.when(F.col("prefix") == mapped, 0).otherwise(1))).alias("file")).select("cell_id", "channel", "file.path", "file.length")
    if cells is not None:
        wanted = spark.createDataFrame([(c, ch) for c in cells for ch in channels], "cell_id string, channel string")  # as long as the argument
        missing = wanted.join(found, ["cell_id", "channel"], "left_anti").orderBy("cell_id", "channel").take(5)
        if missing:
            raise FileNotFoundError(f"no file for {', '.join(f'{r.cell_id}/{r.channel}' for r in missing)} under {root}")
    return found


def mode_size(sizes: DataFrame) -> DataFrame:
    """Of (cell_id, channel, h, w) each cell's most frequent size; of equally frequent ones, that of the first
    channel in order."""
    rank = F.array_position(F.array(*map(F.lit, SIZE_ORDER)), F.col("channel"))
    counts = sizes.groupBy("cell_id", "h", "w").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
    return counts.groupBy("cell_id").agg(F.max_by(F.struct("h", "w"), F.struct("n", -F.col("first"))).alias("size")).select("cell_id", "size.h", "size.w")


def load_cells(spark: SparkSession, root: str, cells: list[str] | None = None, channels: tuple[str, ...] = ("phase", "actin", "mt", "nuc"), channel_map: dict[str, str] | None = None) -> DataFrame:
    """(cell_id, channel, image): gray (combo RGB), each cell's channels in its most frequent size. Only the chosen files are opened,
    once; what was decoded is written to the shared folder. A file that can't be read raises FileNotFoundError."""
    rows = written(opened(spread(resolve_channels(spark, root, cells, channels, channel_map))))
    if bad := rows.where("error IS NOT NULL").select("path", "error").take(1):
        raise FileNotFoundError(f"{bad[0].path}: {bad[0].error}")
    sizes = mode_size(rows.select("cell_id", "channel", "image.h", "image.w"))
    out = rows.join(sizes, "cell_id").select("cell_id", "channel", "image", "h", "w")

    def unify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            images = []
            for row in pdf.itertuples():
                a = unpack(dict(row.image) if isinstance(row.image, dict) else row.image.asDict())
                if row.channel == "combo":
                    a = np.stack([a] * 3, -1) if a.ndim == 2 else a[..., :3]
                elif a.ndim == 3:
                    a = raster.gray(a.astype(np.float64) / np.iinfo(a.dtype).max).astype(np.float32)
                images.append(pack(raster.resize(a, (row.h, row.w))))
            yield pdf[["cell_id", "channel"]].assign(image=images)

    return out.mapInPandas(unify, StructType([StructField("cell_id", StringType()), StructField("channel", StringType()), StructField("image", RASTER)]))


def verify_cells(sizes: DataFrame, channels: int = 4, least: int = 50, most: int = 5000) -> DataFrame:
    """(cell_id, ok) from (cell_id, channel, h, w): all channels, sides within limits, equal shapes."""
    inside = F.col("h").between(least, most) & F.col("w").between(least, most)
    return sizes.groupBy("cell_id").agg(((F.count_distinct("channel") == channels) & F.bool_and(inside) & (F.count_distinct(F.struct("h", "w")) == 1)).alias("ok"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """S5; an empty path is null."""
    return spark.read.schema(MANIFEST).option("header", "true").csv(path)


def _exists(path: str) -> bool:
    system, at = store(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def first_existing(paths: list[str]) -> str | None:
    """S7."""
    return next((p for p in paths if _exists(p)), None)


def glob_composites(spark: SparkSession, folder: str) -> DataFrame:
    """The color_*.png files, by path."""
    return listed(spark, folder, "color_*.png").orderBy("path")


def write_csv(df: DataFrame, path: str) -> None:
    """With a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_qc(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QC_ROW).option("header", "true").csv(path)


def write_summary(summary: DataFrame, folder: str) -> None:
    """The one-row nested summary as JSON, and as text with three decimals and per cents."""
    names = summary.columns
    summary.select(F.to_json(F.struct(*names)).alias("value")).write.mode("overwrite").text(f"{folder}/summary_json")
    lines = F.array(*[F.format_string(f"{n} {kind}: silhouette %.3f, parent match %.1f%%", F.col(f"{n}.{kind}.silhouette_score"), F.col(f"{n}.{kind}.parent_match_rate") * 100) for n in names if n == "clustering" for kind in ("kmeans", "hierarchical")])
    summary.select(F.explode(lines).alias("value")).write.mode("overwrite").text(f"{folder}/summary_text")


def put(folder: str, name: str, data: bytes) -> str:
    """A file of that name (which can have folders) under a folder, complete or absent; its address."""
    system, base = store(folder)
    target = f"{base.rstrip('/')}/{name}"
    parent, _, last = target.rpartition("/")
    system.create_dir(parent, recursive=True)
    part = f"{parent}/.{last}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, target)
    return f"{folder.rstrip('/')}/{name}"


def write_images(rows: DataFrame, folder: str, name: str = "name", image: str = "image") -> DataFrame:
    """Each image as a PNG of that name in a folder of any file system that all tasks reach; (name, path, error) of each.
    A file is complete or absent. Whoever drops the rows must look at `error` first, or use `all_images`."""
    schema = "name string, path string, error string"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for n, r in zip(pdf["name"], pdf["image"], strict=True):
                try:
                    if r is None or not n:
                        raise ValueError("no name" if r is not None else "no image")
                    a = unpack(dict(r) if isinstance(r, dict) else r.asDict())
                    out.append((n, put(folder, n, png.encode(a if a.dtype == np.uint8 else raster.to_byte(a))), None))
                except Exception as e:  # the row keeps the reason
                    out.append((n, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["name", "path", "error"])

    return rows.select(F.col(name).alias("name"), F.col(image).alias("image")).mapInPandas(write, schema)


def all_images(rows: DataFrame, folder: str, name: str = "name", image: str = "image") -> int:
    """S12 where nothing may be missing: writes each image, once, and returns how many; raises OSError, with the first reasons, if any of them
    could not be written."""
    done = written(write_images(rows, folder, name, image))
    n, failed = done.agg(F.count(F.lit(1)), F.count("error")).first()
    first = done.where("error IS NOT NULL").orderBy("name").take(3) if failed else []
    discard(done)
    if failed:
        raise OSError(f"{failed} of {n} images were not written to {folder}: {'; '.join(f'{r.name}: {r.error}' for r in first)}")
    return n


def copy_files(paths: DataFrame, folder: str) -> DataFrame:
    """Copies each path of the only column, from and to any file system that all tasks reach; (path, copied)."""

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for path in pdf.iloc[:, 0]:
                system, at = store(path)
                with system.open_input_stream(at) as data:
                    done.append(put(folder, at.rpartition("/")[2], data.read()))
            yield pd.DataFrame({"path": pdf.iloc[:, 0], "copied": done})

    return paths.mapInPandas(copy, "path string, copied string")


def expected_cells(found: DataFrame, cells: list[str]) -> Column:
    """F1 as a condition on an aggregate: the cells found are exactly those expected."""
    return F.array_sort(F.collect_set("cell_id")) == F.array(*map(F.lit, sorted(cells)))
