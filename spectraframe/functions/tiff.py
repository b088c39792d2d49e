"""A codec of TIFF files: the first image; strips or tiles of 1 (bilevel), 8 or 16 bits, or 32-bit floats; gray, palette or RGB(A); raw,
PackBits, LZW or deflate, with horizontal differences or without. Written are raw, LZW and deflate strips."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: The format's tags, field sizes and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_ROWS, SIZES, PLANAR, PREDICTOR, PALETTE = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, FORMAT = 322, 323, 324, 325, 339
FIELDS = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257


def _lzw(data: bytes) -> bytes:
    out, table, width, value, n, before = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        value, n = value << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, value = value >> n, value & (1 << n) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            now = table[code]
        elif code == len(table) and before:
            now = before + before[:1]
        else:
            raise ValueError("a code that is not yet in the table")
        out += now
        if before:
            table.append(before + now[:1])
        before = now
        width = max(9, min(12, (len(table) + 1).bit_length()))
    return bytes(out)


def _packbits(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out += data[k + 1 : k + 2 + n]
            k += 2 + n
        elif n > 128:
            out += data[k + 1 : k + 2] * (257 - n)
            k += 2
        else:
            k += 1
    return bytes(out)


_DECODERS = {RAW: bytes, LZW: _lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: _packbits}


def _tags(data: bytes, order: str) -> dict[int, tuple]:
    (at,) = struct.unpack(order + "I", data[4:8])
    (count,) = struct.unpack(order + "H", data[at : at + 2])
    tags = {}
    for k in range(count):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind not in FIELDS:
            continue
        shape = f"{order}{n}{FIELDS[kind]}"
        size = struct.calcsize(shape)
        where = entry[8 : 8 + size] if size <= 4 else data[(p := struct.unpack(order + "I", entry[8:])[0]) : p + size]
        tags[tag] = struct.unpack(shape, where)
    return tags


def decode(data: bytes) -> np.ndarray:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if not order:
        raise ValueError("not a TIFF file")
    tags = _tags(data, order)
    if WIDTH not in tags or HEIGHT not in tags:
        raise ValueError("no size")
    w, h, samples = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    bits, compression, photometric, predictor = tags.get(BITS, (1,)), tags.get(COMPRESSION, (RAW,))[0], tags.get(PHOTOMETRIC, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    planes = samples if tags.get(PLANAR, (1,))[0] == 2 else 1
    kind = {(1, 1): "u1", (8, 1): "u1", (16, 1): "u2", (32, 3): "f4"}.get((bits[0], tags.get(FORMAT, (1,))[0]))
    if not kind or len(set(bits)) > 1 or compression not in _DECODERS or predictor not in (1, 2) or (predictor == 2 and kind == "f4") or photometric not in (0, 1, 2, 3):
        raise ValueError(f"bits {bits}, compression {compression}, photometric {photometric}, predictor {predictor}: not supported")
    tiled = TILE_OFFSETS in tags
    th, tw = (tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0]) if tiled else (min(h, tags.get(STRIP_ROWS, (h,))[0]), w)
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_SIZES]) if tiled else (tags[OFFSETS], tags[SIZES])
    inner = samples // planes
    across, down = -(-w // tw), -(-h // th)
    out = np.zeros((planes, down * th, across * tw, inner), kind)
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, place = divmod(k, across * down)
        y, x = divmod(place, across)
        rows = th if tiled else min(th, h - y * th)
        raw = np.frombuffer(_DECODERS[compression](data[offset : offset + size]), np.uint8)
        if bits[0] == 1:
            part = np.unpackbits(raw.reshape(rows, -1), axis=1)[:, :tw, None] * 255
        else:
            width = np.dtype(kind).itemsize
            part = raw[: rows * tw * inner * width].view(order + kind).astype(kind).reshape(rows, tw, inner)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind)
        out[plane, y * th : y * th + rows, x * tw : (x + 1) * tw] = part
    image = out[:, :h, :w].transpose(1, 2, 0, 3).reshape(h, w, samples)
    if photometric == 3:
        return (np.array(tags[PALETTE]).reshape(3, -1).T[image[..., 0]] >> 8).astype(np.uint8)
    if photometric == 0:
        image = np.iinfo(image.dtype).max - image
    return image[..., 0] if samples == 1 else image


def _lzw_of(data: bytes) -> bytes:
    """Single bytes as codes of nine bits, with a new table before codes get longer."""
    bits = []
    for lo in range(0, len(data) or 1, 200):
        bits += [format(CLEAR, "09b"), *(format(b, "09b") for b in data[lo : lo + 200])]
    line = "".join(bits) + format(END, "09b")
    line += "0" * (-len(line) % 8)
    return int(line, 2).to_bytes(len(line) // 8, "big")


def encode(a: np.ndarray, compression: int = DEFLATE, rows: int = 64) -> bytes:
    """8 or 16 bits, gray or RGB, in strips of so many rows, with horizontal differences unless raw."""
    h, w = a.shape[:2]
    samples = 1 if a.ndim == 2 else a.shape[2]
    a = a.reshape(h, w, samples)
    if compression != RAW:
        a = np.diff(a, axis=1, prepend=np.zeros((h, 1, samples), a.dtype)).astype(a.dtype)
    pack = {RAW: bytes, LZW: _lzw_of, DEFLATE: zlib.compress}[compression]
    strips = [pack(a[y : y + rows].astype(a.dtype.newbyteorder("<")).tobytes()) for y in range(0, h, rows)]
    at = np.cumsum([8, *map(len, strips)]).tolist()
    tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [a.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples > 1 else 1]), (OFFSETS, 4, at[:-1]), (SAMPLES, 3, [samples]), (STRIP_ROWS, 4, [rows]), (SIZES, 4, list(map(len, strips))), (PREDICTOR, 3, [1 if compression == RAW else 2])]
    directory = at[-1] + at[-1] % 2
    extra, entries = b"", b""
    for tag, kind, values in tags:
        body = struct.pack(f"<{len(values)}{FIELDS[kind]}", *values)
        if len(body) > 4:
            place = struct.pack("<I", directory + 6 + 12 * len(tags) + len(extra))
            extra += body + b"\0" * (len(body) % 2)
        else:
            place = body.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + place
    return b"II*\0" + struct.pack("<I", directory) + b"".join(strips) + b"\0" * (at[-1] % 2) + struct.pack("<H", len(tags)) + entries + bytes(4) + extra
