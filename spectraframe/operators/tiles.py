"""Rasters that are larger than a task: tiles, stencils with rims from the neighbours, and components across tiles.

A tile is a row (image_id, ty, tx, r0, c0, height, width, tile): its place in the grid, its first pixel, its image's size, and its pixels. A
stencil sends each tile's rims to the tiles beside it, so one shuffle brings every tile what lies within a radius; at the image's edge
pixels are reflected, repeated or constant. Components are labelled within tiles; pixels on both sides of a border give edges, and
only these go into `graph.components`. Tasks take tiles of one shape together, as stacks of some megabytes. A component's properties are sums over its parts, so no image is ever in one place. A part is
named by the place of its first pixel in the image, row by row, and a component by that of its first part, so labels are
numbered as in the whole image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions import regions
from ..schemas import RASTER
from ..sources.rasters import pack, unpack
from .graph import components
from .tables import written

Kernel = Callable[[np.ndarray], np.ndarray]
_PLACE = ("ty", "tx", "r0", "c0", "height", "width")
STEP_BYTES, STEP_ROWS = 1 << 21, 2048  # what a task takes of its rows at a time


def _schema(images: DataFrame, *more: StructField) -> StructType:
    return StructType([images.schema["image_id"], *(StructField(c, IntegerType()) for c in _PLACE), *more])


def _of(r) -> np.ndarray:
    return unpack(r if isinstance(r, dict) else r.asDict())


def _alike(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The places of each distinct row of some columns of numbers."""
    if not len(columns[0]):
        return []
    _, code = np.unique(np.stack(columns, 1).astype(np.int64), axis=0, return_inverse=True)
    order = np.argsort(code.ravel(), kind="stable")
    return np.split(order, np.flatnonzero(np.diff(code.ravel()[order])) + 1)


class _Stacks:
    """Rasters of an Arrow column: those of one shape and type are taken out as one array."""

    def __init__(self, column: pa.Array):
        h, w, c, kind, self.data = column.flatten()
        self.h, self.w, self.c = (x.to_numpy(zero_copy_only=False) for x in (h, w, c))
        coded = kind.dictionary_encode()
        self.kind, self.names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()

    def alike(self) -> list[np.ndarray]:
        return _alike([self.h, self.w, self.c, self.kind])

    def take(self, at: np.ndarray) -> np.ndarray:
        """The rasters at some places, all of one shape and type."""
        k = at[0]
        shape = (len(at), int(self.h[k]), int(self.w[k]), *([int(self.c[k])] if self.c[k] != 1 else []))
        bytes_ = self.data.take(pa.array(at)).buffers()[2]
        return np.frombuffer(bytes_, self.names[self.kind[k]], int(np.prod(shape))).reshape(shape)


def _packed(stack: np.ndarray) -> pa.Array:
    """A column of the rasters of a stack."""
    n, h, w = stack.shape[:3]
    pixels = np.ascontiguousarray(stack).reshape(-1).view(np.uint8)
    offsets = np.arange(n + 1, dtype=np.int32) * (len(pixels) // n)
    numbers = [pa.array(np.full(n, x, np.int32)) for x in (h, w, stack.shape[3] if stack.ndim == 4 else 1)]
    data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(pixels)])
    return pa.StructArray.from_arrays([*numbers, pa.array([stack.dtype.name] * n, pa.string()), data], fields=list(to_arrow_schema(RASTER)))


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _batch(arrow: pa.Schema, ids: pa.Array, numbers: list, last: list[pa.Array]) -> pa.RecordBatch:
    """image_id, numbers (those of all rows, or of each) and the last columns."""
    given = [pa.array(np.broadcast_to(x, len(ids)).astype(np.int32)) for x in numbers]
    return pa.RecordBatch.from_arrays([ids, *given, *last], schema=arrow)


def _parts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts a batch where STEP_BYTES or STEP_ROWS are reached; sizes: bytes of each row, or each group."""
    total, lo = np.concatenate([[0], np.cumsum(sizes)]), 0
    while lo < len(sizes):
        hi = min(lo + STEP_ROWS, max(lo + 1, int(np.searchsorted(total, total[lo] + STEP_BYTES, "right")) - 1))
        yield lo, hi
        lo = hi


def _sizes(rasters: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(rasters.flatten()[4]), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _few(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in _parts(_sizes(batch.column(column))):
            yield batch.slice(lo, hi - lo)


def cut(images: DataFrame, side: int) -> DataFrame:
    """Tiles of `side` by `side` pixels, smaller at the right and lower edge, of (image_id, image)."""
    schema = _schema(images, StructField("tile", RASTER))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, "image"):
            found = _Stacks(batch.column("image"))
            for at in found.alike():
                a, ids = found.take(at), batch.column("image_id").take(pa.array(at))
                h, w = a.shape[1:3]
                for r in range(0, h, side):
                    for c in range(0, w, side):
                        yield _batch(arrow, ids, [r // side, c // side, r, c, h, w], [_packed(a[:, r : r + side, c : c + side])])

    return images.select("image_id", "image").mapInArrow(run, schema)


def _reflected(lo: int, hi: int, n: int, mode: str) -> np.ndarray:
    """The pixels that stand for lo to hi - 1 in a line of n: `reflect` repeats the edge pixel first, `nearest` it alone."""
    k = np.arange(lo, hi)
    if mode == "reflect":
        k = k % (2 * n)
        return np.where(k < n, k, 2 * n - 1 - k)
    return np.clip(k, 0, n - 1)


def _groups(batches: Iterator[pa.RecordBatch], size: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by image_id, ty and tx: whole groups of these, a few megabytes at a time, and where each of them begins."""
    left = None

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        keys = [batch.column("image_id").dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False), *_numbers(batch, "ty", "tx")]
        return np.concatenate([[0], np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1])

    for batch in batches:
        if left is not None:
            batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        first = starts(batch)
        whole, sizes = first[:-1], _sizes(batch.column(size))
        for lo, hi in _parts(np.add.reduceat(sizes, first)[:-1]):
            yield batch.slice(whole[lo], first[hi] - whole[lo]), whole[lo:hi] - whole[lo]
        left = batch.slice(first[-1])  # its group can go on in the next batch
    if left is not None:
        yield left, np.array([0])


def _met(tiles: DataFrame, radius: int, side: int, of: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]], schema: StructType, mode: str, outside: float) -> DataFrame:
    """What of(the first rows of some groups, their tiles with `radius` pixels more on each side as a stack) gives; all tiles of a stack have one place in
    their image as far as its edges show, one shape and one type."""
    reach = -(-radius // side)
    pieces = StructType([tiles.schema["image_id"], *(StructField(c, IntegerType()) for c in (*_PLACE, "y", "x")), StructField("piece", RASTER)])
    arrow = to_arrow_schema(pieces)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, "tile"):
            found = _Stacks(batch.column("tile"))
            ty, tx, r0, c0, height, width = _numbers(batch, *_PLACE)
            for dy in range(-reach, reach + 1):
                for dx in range(-reach, reach + 1):
                    to_y, to_x = ty + dy, tx + dx
                    y0, y1 = np.maximum(r0, to_y * side - radius), np.minimum(r0 + found.h, (to_y + 1) * side + radius)
                    x0, x1 = np.maximum(c0, to_x * side - radius), np.minimum(c0 + found.w, (to_x + 1) * side + radius)
                    inside = (to_y >= 0) & (to_y * side < height) & (to_x >= 0) & (to_x * side < width)
                    sent = np.flatnonzero(inside & (y0 < y1) & (x0 < x1))
                    shape = [found.h, found.w, found.c, found.kind, y0 - r0, y1 - r0, x0 - c0, x1 - c0]
                    for part in _alike([x[sent] for x in shape]):
                        at = sent[part]
                        top, low, first, last = (int(x[at[0]]) for x in shape[4:])
                        numbers = [x[at] for x in (to_y, to_x, to_y * side, to_x * side, height, width, y0, x0)]
                        yield _batch(arrow, batch.column("image_id").take(pa.array(at)), numbers, [_packed(found.take(at)[:, top:low, first:last])])

    def near_edge(first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The same for all lines in whose reach no edge is."""
        edge = (first < radius) | (first + side + radius > size)
        return [np.where(edge, x, -1) for x in (first, size)]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _groups(batches, "piece"):
            found = _Stacks(batch.column("piece"))
            r0, c0, height, width, y, x = _numbers(batch, "r0", "c0", "height", "width", "y", "x")
            y, x = y - np.maximum(0, r0 - radius), x - np.maximum(0, c0 - radius)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, batch.num_rows)))
            kinds = [v[starts] for v in (*near_edge(r0, height), *near_edge(c0, width), found.c, found.kind)]
            for groups in _alike(kinds):
                slot = np.full(len(starts), -1)
                slot[groups] = np.arange(len(groups))
                k = starts[groups[0]]
                h, w, top, left = (int(v[k]) for v in (height, width, r0, c0))
                low, right = min(h, top + side), min(w, left + side)
                more = [int(found.c[k])] if found.c[k] != 1 else []
                known_h, known_w = min(h, low + radius) - max(0, top - radius), min(w, right + radius) - max(0, left - radius)
                known = np.zeros((len(groups), known_h, known_w, *more), found.names[found.kind[k]])
                mine = np.flatnonzero(slot[group] >= 0)
                for part in _alike([v[mine] for v in (y, x, found.h, found.w)]):
                    at = mine[part]
                    i, j = int(y[at[0]]), int(x[at[0]])
                    known[slot[group[at]], i : i + int(found.h[at[0]]), j : j + int(found.w[at[0]])] = found.take(at)
                if mode == "constant":
                    full = np.full((len(groups), low - top + 2 * radius, right - left + 2 * radius, *more), outside, known.dtype)
                    i, j = max(0, radius - top), max(0, radius - left)
                    full[:, i : i + known_h, j : j + known_w] = known
                else:
                    full = known[:, _reflected(top - radius, low + radius, h, mode) - max(0, top - radius)][:, :, _reflected(left - radius, right + radius, w, mode) - max(0, left - radius)]
                yield from of(batch.select(["image_id", *_PLACE]).take(pa.array(starts[groups])), full)

    key = ("image_id", "ty", "tx")
    return tiles.mapInArrow(send, pieces).repartition(*key).sortWithinPartitions(*key).mapInArrow(meet, schema)


def with_rims(tiles: DataFrame, radius: int, side: int, of: Callable[[np.ndarray, dict], list[dict]], schema: StructType, mode: str = "reflect", outside: float = 0) -> DataFrame:
    """What of(the tile with `radius` pixels more on each side, its place) gives. mode: `reflect`, `nearest` or `constant`. `side` is that of
    the tiles; a radius can be larger. Rims are sent to their tiles by a shuffle; a task goes through its tiles a few megabytes at a time."""
    result = to_arrow_schema(schema)

    def each(places: pa.RecordBatch, full: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pylist([place | row for a, place in zip(full, places.to_pylist(), strict=True) for row in of(a, place)], result)

    return _met(tiles, radius, side, each, schema, mode, outside)


def stencil(tiles: DataFrame, kernel: Kernel, radius: int, side: int, mode: str = "reflect", outside: float = 0) -> DataFrame:
    """Tiles of kernel(pixels), where a pixel's result depends on what lies within the radius. P12 to P15, P2, G1, M1 on tiles."""
    schema = _schema(tiles, StructField("tile", RASTER))
    result = to_arrow_schema(schema)

    def each(places: pa.RecordBatch, full: np.ndarray) -> Iterator[pa.RecordBatch]:
        h, w = full.shape[1:3]
        out = np.stack([kernel(a)[radius : h - radius, radius : w - radius] for a in full])
        yield pa.RecordBatch.from_arrays([*places.columns, _packed(out)], schema=result)

    return _met(tiles, radius, side, each, schema, mode, outside)


def joined(tiles: DataFrame) -> DataFrame:
    """(image_id, image) of tiles, for images that fit into a task."""
    schema = StructType([tiles.schema["image_id"], StructField("image", RASTER)])
    arrow = to_arrow_schema(schema)

    def put(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_of(r["tile"]) for r in rows]
        a = np.zeros((rows[0]["height"], rows[0]["width"], *parts[0].shape[2:]), parts[0].dtype)
        for r, part in zip(rows, parts, strict=True):
            a[r["r0"] : r["r0"] + part.shape[0], r["c0"] : r["c0"] + part.shape[1]] = part
        return pa.Table.from_pylist([{"image_id": rows[0]["image_id"], "image": pack(a)}], arrow)

    return tiles.groupBy("image_id").applyInArrow(put, schema)


# components --------------------------------------------------------------------------------------------------------------

_SUMS = ("area", "sum_r", "sum_c", "sum_rr", "sum_cc", "sum_rc")
_PART = "part bigint, area bigint, r0 int, c0 int, r1 int, c1 int, sum_r bigint, sum_c bigint, sum_rr bigint, sum_cc bigint, sum_rc bigint, perimeter double, edge boolean"


def _perimeters(full: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """Each part's share of its component's perimeter; full: the mask with two pixels more on each side."""
    inner = full[1:-1, 1:-1]
    border = inner & ~(full[:-2, 1:-1] & full[2:, 1:-1] & full[1:-1, :-2] & full[1:-1, 2:])
    h, w = labels.shape
    code = sum((1 if y == x == 1 else 2 if 1 in (y, x) else 10) * border[y : y + h, x : x + w].astype(int) for y in range(3) for x in range(3))
    share = np.zeros(64)
    share[list(regions.PERIMETER)] = list(regions.PERIMETER.values())
    return np.bincount(labels.ravel(), weights=np.where(border[1:-1, 1:-1], share[code], 0).ravel(), minlength=n + 1)[1:]


def _beside(ids: np.ndarray, r0: int, c0: int, h: int, w: int, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pixels of the mask at the upper and left border (place, part), and the places that those at the lower and right one touch (place, part)."""
    rows, cols = np.arange(ids.shape[0]) + r0, np.arange(ids.shape[1]) + c0
    here = [(r0 * w + cols, ids[0]), (rows * w + c0, ids[:, 0])]
    probes = []
    for d in (-1, 0, 1) if diagonal else (0,):
        down, right = (cols + d >= 0) & (cols + d < w) & (rows[-1] + 1 < h), (rows + d >= 0) & (rows + d < h) & (cols[-1] + 1 < w)
        probes += [(((rows[-1] + 1) * w + cols + d)[down], ids[-1][down]), (((rows + d) * w + cols[-1] + 1)[right], ids[:, -1][right])]
    out = []
    for pairs in (here, probes):
        at, part = (np.concatenate(x) for x in zip(*pairs, strict=True))
        out += [at[part >= 0], part[part >= 0]]
    return tuple(out)


class Labelled:
    """Components of mask tiles: `tiles` with each pixel's part (-1: none), `parts` and their components' roots, all written tables."""

    def __init__(self, tiles: DataFrame, side: int, connectivity: int = 8):
        long = ArrayType(LongType())
        more = [StructField(c, long) for c in ("here_at", "here", "probe_at", "probe")]
        schema = _schema(tiles, StructField("tile", RASTER), StructField("parts", ArrayType(StructType.fromDDL(_PART))), *more)
        names = [c.split()[0] for c in _PART.split(", ")]

        def of(full: np.ndarray, place: dict) -> list[dict]:
            mask = full[2:-2, 2:-2]
            labels, n = regions.label(mask, connectivity)
            r, c = np.nonzero(labels)
            k = labels[r, c] - 1
            at = (r + place["r0"]).astype(np.int64) * place["width"] + c + place["c0"]
            first = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(first, k, at)
            ids = np.append(first, -1)[labels - 1]
            r, c = r + place["r0"], c + place["c0"]
            low, high = np.full((2, n), np.iinfo(np.int64).max), np.full((2, n), -1)
            for d, x in enumerate((r, c)):
                np.minimum.at(low[d], k, x)
                np.maximum.at(high[d], k, x)
            sums = [np.bincount(k, minlength=n), *(np.bincount(k, weights=x, minlength=n).astype(np.int64) for x in (r, c, r * r, c * c, r * c))]
            edge = (low[0] == 0) | (low[1] == 0) | (high[0] == place["height"] - 1) | (high[1] == place["width"] - 1)
            columns = [first, sums[0], low[0], low[1], high[0] + 1, high[1] + 1, *sums[1:], _perimeters(full, labels, n), edge]
            parts = [dict(zip(names, row, strict=True)) for row in zip(*(x.tolist() for x in columns), strict=True)]
            here_at, here, probe_at, probe = _beside(ids, place["r0"], place["c0"], place["height"], place["width"], connectivity == 8)
            return [{"tile": pack(ids), "parts": parts, "here_at": here_at, "here": here, "probe_at": probe_at, "probe": probe}]

        self.tiles = written(with_rims(tiles, 2, side, of, schema, "constant"))
        here = self.tiles.select("image_id", F.inline(F.arrays_zip(F.col("here_at").alias("at"), F.col("here").alias("u"))))
        probe = self.tiles.select("image_id", F.inline(F.arrays_zip(F.col("probe_at").alias("at"), F.col("probe").alias("v"))))
        edges = here.distinct().join(probe, ["image_id", "at"]).select(F.col("image_id").alias("group"), "u", "v").distinct()
        roots = components(edges).select(F.col("group").alias("image_id"), F.col("node").alias("part"), "root")
        parts = self.tiles.select("image_id", "ty", "tx", F.inline("parts"))
        self.parts = written(parts.join(roots, ["image_id", "part"], "left").withColumn("root", F.coalesce("root", "part")))

    def components(self) -> DataFrame:
        """A1, A2: (image_id, label, root, area, r0, c0, r1, c1, cy, cx, major, minor, perimeter, edge) of each component; edge: it touches the
        image's edge. The perimeter holds for 8 neighbours."""
        sums = self.parts.groupBy("image_id", "root").agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.min(c).alias(c) for c in ("r0", "c0")], *[F.max(c).alias(c) for c in ("r1", "c1")], F.sum("perimeter").alias("perimeter"), F.bool_or("edge").alias("edge"))
        n = F.col("area")
        cy, cx = F.col("sum_r") / n, F.col("sum_c") / n
        a, c = F.col("sum_rr") / n - cy * cy + 1 / 12, F.col("sum_cc") / n - cx * cx + 1 / 12
        b = F.col("sum_rc") / n - cy * cx
        half = F.sqrt(((a - c) / 2) ** 2 + b * b)
        axes = [(4 * F.sqrt(F.greatest((a + c) / 2 + s * half, F.lit(0.0)))).alias(name) for s, name in ((1, "major"), (-1, "minor"))]
        label = F.row_number().over(Window.partitionBy("image_id").orderBy("root")).alias("label")
        return sums.select("image_id", label, "root", "area", "r0", "c0", "r1", "c1", cy.alias("cy"), cx.alias("cx"), *axes, "perimeter", "edge")

    def chosen(self, roots: DataFrame) -> DataFrame:
        """Mask tiles of the components in (image_id, root)."""
        kept = self.parts.join(roots.select("image_id", "root"), ["image_id", "root"], "left_semi")
        lists = kept.groupBy("image_id", "ty", "tx").agg(F.collect_list("part").alias("kept"))  # parts of one tile
        rows = self.tiles.select("image_id", *_PLACE, "tile").join(lists, ["image_id", "ty", "tx"], "left")
        schema = _schema(self.tiles, StructField("tile", RASTER))

        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _few(batches, "tile"):
                found = _Stacks(batch.column("tile"))
                kept = batch.column("kept").to_pylist()
                for at in found.alike():
                    on = np.stack([np.isin(a, kept[k]) if kept[k] else np.zeros(a.shape, bool) for k, a in zip(at, found.take(at), strict=True)])
                    places = batch.select(["image_id", *_PLACE]).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*places.columns, _packed(on)], schema=arrow)

        return rows.select("image_id", *_PLACE, "tile", "kept").mapInArrow(run, schema)


def remove_small(tiles: DataFrame, side: int, least: int, connectivity: int = 4) -> DataFrame:
    """mask tiles without components of fewer than `least` pixels."""
    found = Labelled(tiles, side, connectivity)
    return found.chosen(found.parts.groupBy("image_id", "root").agg(F.sum("area").alias("area")).where(F.col("area") >= least))


def largest(tiles: DataFrame, side: int, connectivity: int = 8) -> DataFrame:
    """Mask tiles of each image's largest component, the first of equals."""
    found = Labelled(tiles, side, connectivity)
    sizes = found.parts.groupBy("image_id", "root").agg(F.sum("area").alias("area"))
    return found.chosen(sizes.groupBy("image_id").agg(F.max_by("root", F.struct("area", -F.col("root"))).alias("root")))


def fill_holes(tiles: DataFrame, side: int) -> DataFrame:
    """M2: background that no path of straight steps leads to from the image's edge becomes part of the mask."""
    found = Labelled(stencil(tiles, np.logical_not, 0, side), side, 4)
    outside = found.parts.groupBy("image_id", "root").agg(F.bool_or("edge").alias("edge")).where("edge")
    return stencil(found.chosen(outside), np.logical_not, 0, side)


def values(tiles: DataFrame) -> DataFrame:
    """(image_id, r, c, v): a row a pixel."""
    schema = StructType([tiles.schema["image_id"], *StructType.fromDDL("r int, c int, v double").fields])

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, "tile"):
            found = _Stacks(batch.column("tile"))
            r0, c0 = _numbers(batch, "r0", "c0")
            for at in found.alike():
                a = found.take(at)
                n, h, w = a.shape
                rows, cols = r0[at][:, None, None] + np.arange(h)[None, :, None], c0[at][:, None, None] + np.arange(w)[None, None, :]
                numbers = [np.broadcast_to(x, a.shape).ravel() for x in (rows, cols)]
                yield _batch(arrow, batch.column("image_id").take(pa.array(np.repeat(at, h * w))), numbers, [pa.array(a.ravel().astype(float))])

    return tiles.select("image_id", "r0", "c0", "tile").mapInArrow(run, schema)
