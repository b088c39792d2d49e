"""The data source `rasters`: folders of image files, read and written as rows.

    spark.dataSource.register(RasterSource)
    spark.read.format("rasters").load(folder).where("cell_id IN ('a', 'b') AND ext = '.png'")
    rows.write.format("rasters").mode("append").save(folder)  # columns name, image

Reading lists the files and makes partitions of chosen paths, of some 64 MB each; a task opens its own paths only. Conditions on
`cell_id` (the file's folder), `channel` (what stands behind the last underscore) and `ext` are pushed into the listing
(spark.sql.python.filterPushdown.enabled; `registered` sets it): with cells asked for, only their folders are listed. A file that can't
be read has a null image and its reason in `error`.

Writing has a commit: tasks put PNG files into a staging folder beside the target, with their own attempt's name; when all have ended,
the files that the successful attempts named are moved in place. A job that fails leaves none of them, and attempts that failed or ran
twice leave nothing behind. `overwrite` removes what was in the folder at the commit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import formats, png, raster
from ..schemas import RASTER

SCHEMA = StructType([*(StructField(c, StringType()) for c in ("path", "cell_id", "prefix", "channel", "ext")), StructField("length", LongType()), StructField("image", RASTER), StructField("error", StringType())])
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 16 << 20  # of decoded images, in an Arrow batch
_NAME = re.compile(r"(?:(?P<cell_id>[^/]+)/)?(?P<stem>[^/]+?)(?P<ext>\.[A-Za-z]+)$")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def pack(a: np.ndarray) -> dict:
    return {"h": a.shape[0], "w": a.shape[1], "c": 1 if a.ndim == 2 else a.shape[2], "dtype": a.dtype.name, "data": np.ascontiguousarray(a).tobytes()}


def unpack(r: dict | None) -> np.ndarray | None:
    if r is None or r["data"] is None:
        return None
    a = np.frombuffer(r["data"], r["dtype"])
    h, w, c = int(r["h"]), int(r["w"]), int(r["c"])  # pandas makes them floats beside a row without an image
    return a.reshape(h, w) if c == 1 else a.reshape(h, w, c)


def read_image(path: str) -> tuple[dict | None, str | None]:
    """The packed image of a file, or the reason why there is none."""
    try:
        system, at = store(path)
        with system.open_input_stream(at) as f:
            return pack(formats.decode(f.read())), None
    except Exception as e:  # the row keeps the reason
        return None, f"{type(e).__name__}: {e}"


@dataclass
class _Paths(InputPartition):
    rows: list[tuple]


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is None or len(f.attribute) != 1 or f.attribute[0] not in ("cell_id", "channel", "ext"):
                yield f
            else:
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & set(values) if name in self.wanted else set(values)

    def files(self) -> list[tuple]:
        """(path, cell_id, prefix, channel, ext, length) of the files that are wanted, by path."""
        system, base = store(self.folder)
        base = base.rstrip("/")
        scheme = self.folder.partition(base)[0] if base in self.folder else ""
        roots = [base] if "cell_id" not in self.wanted else [f"{base}/{c}" for c in sorted(self.wanted["cell_id"])]
        found = []
        for root in roots:
            for info in system.get_file_info(fs.FileSelector(root, allow_not_found=root != base, recursive=True)):
                if info.type != fs.FileType.File or info.base_name[0] in "._":
                    continue
                if not (m := _NAME.search(info.path[len(base) + 1 :])):
                    continue
                prefix, _, channel = m["stem"].rpartition("_")
                row = {"cell_id": m["cell_id"], "prefix": prefix, "channel": channel, "ext": m["ext"]}
                if all(row[k] in v for k, v in self.wanted.items()):
                    found.append((scheme + info.path, *row.values(), info.size))
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        parts: list[list[tuple]] = []
        size = PARTITION_BYTES
        for row in self.files():
            if size + row[-1] > PARTITION_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(row)
            size += row[-1]
        return [_Paths(p) for p in parts] or [_Paths([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        schema, batch, size = to_arrow_schema(SCHEMA), [], 0
        for row in partition.rows:
            image, error = read_image(row[0])
            batch.append(dict(zip(SCHEMA.names, (*row, image, error), strict=True)))
            size += len(image["data"]) if image else 0
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(batch, schema)
                batch, size = [], 0
        yield pa.RecordBatch.from_pylist(batch, schema)


@dataclass
class _Written(WriterCommitMessage):
    staged: str
    names: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.staging = folder, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = store(self.folder)
        task = TaskContext.get()
        staged, names = f"{base.rstrip('/')}/{self.staging}/{task.partitionId()}-{task.taskAttemptId()}", []
        for batch in iterator:
            for row in batch.select(["name", "image"]).to_pylist():
                a = unpack(row["image"])
                target = f"{staged}/{row['name']}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as f:
                    f.write(png.encode(a if a.dtype in (np.uint8, np.uint16) else raster.to_byte(a)))
                names.append(row["name"])
        return _Written(staged, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = store(self.folder)
        base = base.rstrip("/")
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if info.base_name != self.staging:
                    (system.delete_dir if info.type == fs.FileType.Directory else system.delete_file)(info.path)
        moves = {f"{base}/{n}": f"{m.staged}/{n}" for m in messages if m for n in m.names}  # of one name twice, the last
        for folder in {target.rpartition("/")[0] for target in moves}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda move: system.move(move[1], move[0]), moves.items()))
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = store(self.folder)
        target = f"{base.rstrip('/')}/{self.staging}"
        if system.get_file_info(target).type != fs.FileType.NotFound:
            system.delete_dir(target)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasters"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if missing := {"name", "image"} - set(schema.names):
            raise ValueError(f"rows to write need the columns name and image; there is no {', '.join(sorted(missing))}")
        return _Writer(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the source and its pushdown, as this thread's own: a source is looked up in the thread's session."""
    spark.createDataFrame([], "a int")  # sets it
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    return spark
