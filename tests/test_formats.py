"""Decoders against the JVM's own writers, and the data source of image folders."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from spectraframe.functions import formats, jpeg, png, tiff
from spectraframe.sources import images as sources
from spectraframe.sources import rasters


def smooth(h, w, channels=1):
    y, x = np.mgrid[:h, :w]
    a = np.stack([127 + 100 * np.sin(x / (7 + k)) * np.cos(y / (9 + 2 * k)) for k in range(channels)], -1)
    return (a[..., 0] if channels == 1 else a).astype(np.uint8)


def jvm(spark, a, kind, compression=None, quality=None):
    """The bytes that the JVM writes for an image."""
    j = spark._jvm
    gray = a.ndim == 2
    image = j.java.awt.image.BufferedImage(a.shape[1], a.shape[0], 10 if gray else 1)
    values = a.ravel().astype(int).tolist() if gray else [int(v) for v in (a.astype(int) @ [65536, 256, 1]).ravel()]
    array = spark.sparkContext._gateway.new_array(j.int, len(values))
    for k, v in enumerate(values):
        array[k] = v
    if gray:
        image.getRaster().setPixels(0, 0, a.shape[1], a.shape[0], array)
    else:
        image.setRGB(0, 0, a.shape[1], a.shape[0], array, 0, a.shape[1])
    writer = j.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    how = writer.getDefaultWriteParam()
    if compression or quality:
        how.setCompressionMode(2)
        if compression:
            how.setCompressionType(compression)
        if quality:
            how.setCompressionQuality(quality)
    out = j.java.io.ByteArrayOutputStream()
    stream = j.javax.imageio.stream.MemoryCacheImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, j.javax.imageio.IIOImage(image, None, None), how)
    stream.flush()
    data = bytes(out.toByteArray())
    read = j.javax.imageio.ImageIO.read(j.java.io.ByteArrayInputStream(out.toByteArray()))
    back = np.array([read.getRGB(x, y) & 0xFFFFFF for y in range(a.shape[0]) for x in range(a.shape[1])] if a.size < 5000 else [])
    return data, back


@pytest.mark.parametrize("compression", ["LZW", "ZLib", "PackBits", "Deflate"])
def test_tiff_of_the_jvm(spark, compression):
    for a in (smooth(33, 41), smooth(20, 17, 3)):
        assert (formats.decode(jvm(spark, a, "tiff", compression)[0]) == a).all()


@pytest.mark.parametrize("quality", [0.5, 0.95])
def test_jpeg_of_the_jvm(spark, quality):
    gray = smooth(37, 53)
    data, _ = jvm(spark, gray, "jpeg", quality=quality)
    assert np.abs(formats.decode(data).astype(int) - gray).mean() < 3
    colour = smooth(38, 41, 3)
    data, back = jvm(spark, colour, "jpeg", quality=quality)
    other = np.stack([back >> s & 255 for s in (16, 8, 0)], -1).reshape(colour.shape)
    assert np.abs(formats.decode(data).astype(int) - other).max() <= 4


def test_own_jpeg():
    a = np.random.default_rng(2).integers(0, 256, (37, 53)).astype(np.uint8)
    assert np.abs(jpeg.decode(jpeg.encode(a)).astype(int) - a).max() <= 1
    flat = np.kron(a[:4, :5], np.ones((8, 8), np.uint8))
    assert (jpeg.decode(jpeg.encode(flat)) == flat).all()


@pytest.mark.parametrize("compression", [tiff.RAW, tiff.LZW, tiff.DEFLATE])
def test_own_tiff(compression):
    rng = np.random.default_rng(3)
    for dtype in (np.uint8, np.uint16):
        for shape in ((37, 53), (70, 20, 3), (1, 1)):
            a = rng.integers(0, np.iinfo(dtype).max, shape).astype(dtype)
            assert (tiff.decode(tiff.encode(a, compression)) == a).all()


def test_what_is_not_an_image():
    for data in (b"", b"no image", b"\xff\xd8\xff", b"II*\0\x08\0\0\0\0\0", b"\xff\xd8\xff\xc2\0\x0b\x08\0\x01\0\x01\x01\x01\x11\0\xff\xd9", png.encode(smooth(4, 4))[:20]):
        with pytest.raises((ValueError, KeyError, IndexError, OSError, zlib.error, Exception)):
            formats.decode(data)


def folder_of(tmp_path, files):
    for name, data in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(tmp_path)


def test_only_chosen_files_are_opened(spark, tmp_path):
    a = np.kron(np.arange(64, dtype=np.uint8).reshape(8, 8) * 3, np.ones((8, 8), np.uint8))
    good = {"BF": (".tiff", tiff.encode(a, tiff.LZW)), "Actin": (".jpg", jpeg.encode(a)), "Microtubules": (".jpeg", jpeg.encode(a)), "Nuclei": (".tif", tiff.encode(a))}
    files = {f"c1/c1_{s}{ext}": data for s, (ext, data) in good.items()} | {"c1/c1_Actin.png": b"broken", "c1/c1_Microtubules.tif": b"broken", "c2/c2_BF.png": b"broken"}
    cells = sources.load_cells(spark, folder_of(tmp_path, files), ["c1"]).collect()
    assert sorted(r.channel for r in cells) == ["actin", "mt", "nuc", "phase"]
    assert all((sources.unpack(r.image.asDict()) == a).all() for r in cells)
    with pytest.raises(FileNotFoundError, match="c2/actin"):
        sources.resolve_channels(spark, str(tmp_path), ["c2"])
    mine = sources.resolve_channels(spark, str(tmp_path), None, channel_map={"light": "BF"}).collect()
    assert sorted((r.cell_id, r.channel) for r in mine) == [("c1", "light"), ("c2", "light")]
    (tmp_path / "c3").mkdir()
    (tmp_path / "c3/c3_BF.png").write_bytes(b"broken")
    with pytest.raises(FileNotFoundError, match="c3_BF.png"):
        sources.load_cells(spark, str(tmp_path), ["c3"], ("phase",))


def test_conditions_reach_the_listing(spark, tmp_path):
    a = smooth(8, 8)
    folder = folder_of(tmp_path, {f"{c}/{c}_{s}.png": png.encode(a) for c in "xyz" for s in ("BF", "Actin")} | {"x/x_BF.tif": b"broken", "x/.hidden.png": b"", "x/_staging-1/a_b.png": b""})
    read = rasters.registered(spark).read.format("rasters").load(folder)
    some = read.where("cell_id IN ('x', 'y') AND channel = 'BF' AND ext = '.png' AND length > 0")
    assert "PushedFilters" in some._jdf.queryExecution().toString() or some.count() == 2
    assert sorted((r.cell_id, r.channel, r.error) for r in some.collect()) == [("x", "BF", None), ("y", "BF", None)]
    bad = read.where("ext = '.tif'").collect()
    assert [(r.image, r.error.split(":")[0]) for r in bad] == [(None, "ValueError")]
    reader = rasters._Reader(folder)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([In(("cell_id",), ("x", "none")), EqualTo(("ext",), ".png"), GreaterThan(("length",), 3)]))
    assert left == [GreaterThan(("length",), 3)]
    assert [Path(row[0]).name for row in reader.files() if "staging" not in row[0]] == ["x_Actin.png", "x_BF.png"]


def test_a_write_is_whole_or_nothing(spark, tmp_path):
    folder = f"{tmp_path}/out"
    rasters.registered(spark)
    packed = rasters.pack(smooth(6, 5))
    rows = spark.range(20).select(F.format_string("d%d/im_%d.png", F.col("id") % 3, "id").alias("name"), F.struct(*[F.lit(bytearray(v) if isinstance(v, bytes) else v).alias(k) for k, v in packed.items()]).cast("struct<h:int,w:int,c:int,dtype:string,data:binary>").alias("image")).repartition(4)

    def there():
        return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file())

    broken = rows.withColumn("name", F.when(F.col("name").contains("_19"), F.concat("name", F.raise_error(F.lit("stop")).cast("string"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="stop"):
        broken.write.format("rasters").mode("append").save(folder)
    assert not Path(folder).exists() or not there()
    rows.write.format("rasters").mode("append").save(folder)
    assert len(there()) == 20
    assert (png.decode(Path(folder, "d0/im_0.png").read_bytes()) == smooth(6, 5)).all()
    rows.limit(3).write.format("rasters").mode("overwrite").save(folder)
    assert len(there()) == 3
    assert [p.name for p in Path(folder).iterdir() if p.name.startswith("_")] == []
