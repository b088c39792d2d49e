"""Decoding of baseline and extended sequential JPEG files with Huffman codes, 8 bits a sample, one or three components; and
encoding of gray images without quantisation."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np


def _zigzag() -> np.ndarray:
    """Places of a block's coefficients in the order in which they are coded: by diagonals, every other one upwards."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([8 * y + x for y, x in order])


ZIGZAG = _zigzag()
_COS = np.cos((2 * np.arange(8)[None] + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]


@dataclass
class _Component:
    name: int
    h: int
    v: int
    table: int
    dc: int = 0
    ac: int = 0
    last: int = 0
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(length, symbol) by the next 16 bits; length 0 where no code begins so."""
    out, code, k = [(0, 0)] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            lo = code << 16 - length
            out[lo : lo + (1 << 16 - length)] = [(length, symbols[k])] * (1 << 16 - length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    """The bits of one run of entropy-coded bytes, zeros behind its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.n = data + bytes(8), 0, 0, 0

    def peek(self) -> int:
        if self.n < 32:
            self.value = (self.value & (1 << self.n) - 1) << 32 | int.from_bytes(self.data[self.at : self.at + 4].ljust(4, b"\0"), "big")
            self.at += 4
            self.n += 32
        return self.value >> self.n - 16 & 0xFFFF

    def symbol(self, table: list[tuple[int, int]]) -> int:
        length, symbol = table[self.peek()]
        if not length:
            raise ValueError("a code that no table has")
        self.n -= length
        return symbol

    def signed(self, size: int) -> int:
        """A number of so many bits; those with a leading zero are negative."""
        if not size:
            return 0
        x = self.peek() >> 16 - size
        self.n -= size
        return x if x >> size - 1 else x - (1 << size) + 1


def _block(bits: _Bits, c: _Component, out: np.ndarray, tables: dict) -> None:
    c.last += bits.signed(bits.symbol(tables[0, c.dc]))
    out[0] = c.last
    ac, k = tables[1, c.ac], 1
    while k < 64:
        symbol = bits.symbol(ac)
        if symbol & 15:
            k += symbol >> 4
            if k > 63:
                raise ValueError("a run beyond its block")
            out[ZIGZAG[k]] = bits.signed(symbol & 15)
            k += 1
        elif symbol == 0xF0:
            k += 16
        else:
            break


def _scan(data: bytes, at: int, some: list[_Component], tables: dict, every: int, size: tuple[int, int], most: tuple[int, int]) -> int:
    """Reads the blocks of a scan, which begins at `at`; where it ends."""
    end = at
    while not (data[end] == 0xFF and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
        end = data.find(b"\xff", end + 1)
        if end < 0 or end + 1 >= len(data):
            raise ValueError("the file ends within a scan")
    parts, lo, k = [], at, data.find(b"\xff", at, end)
    while k >= 0:  # restart markers cut it; a stuffed zero follows each other byte 255
        if data[k + 1]:
            parts.append(data[lo:k])
            lo = k + 2
        k = data.find(b"\xff", k + 2, end)
    runs = [_Bits(p.replace(b"\xff\x00", b"\xff")) for p in [*parts, data[lo:end]]]
    (h, w), (hy, hx) = size, most
    if len(some) == 1:  # a block at a time, without those that only fill up a unit
        c = some[0]
        ny, nx = (-(-(-(-n * f // m)) // 8) for n, f, m in ((h, c.v, hy), (w, c.h, hx)))
        units = [[(c, y, x)] for y in range(ny) for x in range(nx)]
    else:
        units = [[(c, y * c.v + j, x * c.h + i) for c in some for j in range(c.v) for i in range(c.h)] for y in range(-(-h // (8 * hy))) for x in range(-(-w // (8 * hx)))]
    for k, unit in enumerate(units):
        if every and k % every == 0:
            for c in some:
                c.last = 0
        run = runs[k // every if every else 0]
        for c, y, x in unit:
            _block(run, c, c.blocks[y, x], tables)
    return end


def _doubled(a: np.ndarray) -> np.ndarray:
    """Twice as many columns, each a quarter of its neighbour's."""
    before, after = np.concatenate([a[:, :1], a[:, :-1]], 1), np.concatenate([a[:, 1:], a[:, -1:]], 1)
    return np.stack([(3 * a + before + 1) >> 2, (3 * a + after + 2) >> 2], -1).reshape(len(a), -1)


def _plane(c: _Component, q: np.ndarray, size: tuple[int, int], most: tuple[int, int]) -> np.ndarray:
    """The samples of a component, at the image's size."""
    ny, nx = c.blocks.shape[:2]
    x = (c.blocks * q).reshape(ny, nx, 8, 8)
    samples = np.clip(np.rint(_COS.T @ x @ _COS + 128), 0, 255).astype(np.int32).transpose(0, 2, 1, 3).reshape(ny * 8, nx * 8)
    fy, fx = most[0] // c.v, most[1] // c.h
    samples = samples[: -(-size[0] // fy), : -(-size[1] // fx)]
    if fx == 2 and samples.shape[1] > 2:
        samples = _doubled(samples)
    elif fx > 1:
        samples = np.repeat(samples, fx, 1)
    if fy == 2 and fx == 2 and len(samples) > 2:
        samples = _doubled(samples.T).T
    elif fy > 1:
        samples = np.repeat(samples, fy, 0)
    return samples[: size[0], : size[1]]


def decode(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) of bytes."""
    if not data.startswith(b"\xff\xd8"):
        raise ValueError("not a JPEG file")
    quants: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], list] = {}
    parts: list[_Component] = []
    every, transform, size, most, at = 0, None, (0, 0), (1, 1), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        mark = data[at + 1]
        if mark == 0xFF:  # fill
            at += 1
            continue
        if mark == 0xD9:
            break
        (n,) = struct.unpack(">H", data[at + 2 : at + 4])
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                table = np.zeros(64, np.int64)
                table[ZIGZAG] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                quants[body[0] & 15], body = table, body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15], body = _lookup(body[1:17], body[17 : 17 + total]), body[17 + total :]
        elif mark in (0xC0, 0xC1):
            depth, h, w, count = struct.unpack(">BHHB", body[:6])
            if depth != 8 or count not in (1, 3) or not h or not w:
                raise ValueError(f"{depth} bits, {count} components, {h} by {w}: not supported")
            size = h, w
            parts = [_Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            most = max(c.v for c in parts), max(c.h for c in parts)
            for c in parts:
                c.blocks = np.zeros((-(-h // (8 * most[0])) * c.v, -(-w // (8 * most[1])) * c.h, 64), np.int32)
        elif 0xC2 <= mark <= 0xCF:
            raise ValueError(f"JPEG of kind {mark:#x} (progressive, arithmetic or lossless) is not supported")
        elif mark == 0xDD:
            (every,) = struct.unpack(">H", body)
        elif mark == 0xEE and body.startswith(b"Adobe"):
            transform = body[11]
        elif mark == 0xDA:
            some = []
            for k in range(body[0]):
                c = next(c for c in parts if c.name == body[1 + 2 * k])
                c.dc, c.ac, c.last = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15, 0
                some.append(c)
            at = _scan(data, at, some, tables, every, size, most)
    if not parts:
        raise ValueError("no image")
    planes = [_plane(c, quants[c.table], size, most) for c in parts]
    if len(planes) == 1:
        return planes[0].astype(np.uint8)
    if transform == 0:
        return np.stack(planes, -1).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128.0, planes[2] - 128.0
    return np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)), 0, 255).astype(np.uint8)


def encode(a: np.ndarray) -> bytes:
    """A gray image of bytes, with a quantisation of 1 and codes of one length."""
    h, w = a.shape
    padded = np.pad(a, ((0, -h % 8), (0, -w % 8)), mode="edge").astype(np.float64) - 128
    blocks = padded.reshape(padded.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    coded = np.rint(_COS @ blocks @ _COS.T).astype(int).reshape(-1, 64)[:, ZIGZAG]
    dc, ac = list(range(12)), [0x00, 0xF0, *(16 * run + size for run in range(16) for size in range(1, 11))]
    bits: list[str] = []

    def number(x: int) -> str:
        size = abs(x).bit_length()
        return format(x if x > 0 else x + (1 << size) - 1, f"0{size}b") if size else ""

    last = 0
    for block in coded.tolist():
        bits.append(format(dc.index(abs(block[0] - last).bit_length()), "04b") + number(block[0] - last))
        last, run = block[0], 0
        for x in block[1:]:
            if x:
                bits += [format(ac.index(0xF0), "08b")] * (run // 16)
                bits.append(format(ac.index(16 * (run % 16) + abs(x).bit_length()), "08b") + number(x))
                run = 0
            else:
                run += 1
        if run:
            bits.append(format(ac.index(0), "08b"))
    line = "".join(bits)
    line += "1" * (-len(line) % 8)
    body = int(line, 2).to_bytes(len(line) // 8, "big").replace(b"\xff", b"\xff\x00")

    def part(mark: int, content: bytes) -> bytes:
        return bytes([0xFF, mark]) + struct.pack(">H", len(content) + 2) + content

    def codes(name: int, symbols: list[int], length: int) -> bytes:
        return bytes([name]) + bytes(len(symbols) if k == length else 0 for k in range(1, 17)) + bytes(symbols)

    head = part(0xDB, bytes([0]) + bytes([1]) * 64) + part(0xC0, struct.pack(">BHHB", 8, h, w, 1) + bytes([1, 0x11, 0])) + part(0xC4, codes(0x00, dc, 4) + codes(0x10, ac, 8))
    return b"\xff\xd8" + head + part(0xDA, bytes([1, 1, 0x00, 0, 63, 0])) + body + b"\xff\xd9"
