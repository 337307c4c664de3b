"""JPEG frames by their own tables: lossless grey (SOF3) and baseline (SOF0, SOF1), whose luma counts. A helper for single frames; files that this package writes don't need it."""

from __future__ import annotations

import struct

import numpy as np

# The zigzag order of a block's coefficients, by diagonals.
ZIGZAG = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
_k = np.arange(8)
_COSINE = np.cos((2 * _k[:, None] + 1) * _k[None, :] * np.pi / 16) * np.where(_k == 0, np.sqrt(1 / 8), 0.5)[None, :]


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist(), 0

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            if self.at >= len(self.bits):
                break
            code = code << 1 | self.bits[self.at]
            self.at += 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError("no such code")

    def number(self, size: int) -> int:
        """A difference of `size` bits; a leading 0 means it is negative."""
        if not size:
            return 0
        part = self.bits[self.at : self.at + size]
        if len(part) < size:
            raise ValueError("the scan is too short")
        self.at += size
        value = int("".join(map(str, part)), 2)
        return value if part[0] else value - (1 << size) + 1


def _parse(data: bytes) -> tuple[dict, bytes]:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    got: dict = {"huffman": {}, "quant": {}, "restart": 0}
    at = 2
    while at + 4 <= len(data):
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        part = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while part:
                counts, n = part[1:17], sum(part[1:17])
                code, table, symbols = 0, {}, iter(part[17 : 17 + n])
                for length, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[length, code] = next(symbols)
                        code += 1
                    code <<= 1
                got["huffman"][part[0]], part = table, part[17 + n :]
        elif marker == 0xDB:
            while part:
                wide = part[0] >> 4
                n = 64 * (1 + wide)
                got["quant"][part[0] & 15], part = np.frombuffer(part[1 : 1 + n], ">u2" if wide else "u1").astype(float), part[1 + n :]
        elif marker == 0xDD:
            got["restart"] = struct.unpack(">H", part)[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            bits, height, width, n = struct.unpack_from(">BHHB", part)
            got |= {"kind": marker, "bits": bits, "height": height, "width": width, "parts": [(part[6 + 3 * i], part[7 + 3 * i] >> 4, part[7 + 3 * i] & 15, part[8 + 3 * i]) for i in range(n)]}
        elif 0xC0 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("progressive and arithmetic frames aren't read")
        elif marker == 0xDA:
            n = part[0]
            got["scan"], got["first"], got["shift"] = {part[1 + 2 * i]: part[2 + 2 * i] for i in range(n)}, part[1 + 2 * n], part[3 + 2 * n] & 15
            return got, data[at : -2 if data.endswith(b"\xff\xd9") else None]
    raise ValueError("a frame without a scan")


def _runs(scan: bytes) -> list[bytes]:
    """The scan between its restart markers."""
    out, start, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0:
        if at + 1 < len(scan) and 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[start:at])
            start = at + 2
        at += 2
    return [*out, scan[start:]]


def _lossless(got: dict, scan: bytes) -> np.ndarray:
    height, width, kind = got["height"], got["width"], got["first"]
    if len(got["parts"]) != 1 or got["bits"] != 8 or not 1 <= kind <= 7:
        raise ValueError("not a grey lossless frame of 8 bits")
    table = got["huffman"][got["scan"][got["parts"][0][0]] >> 4]
    out, every = np.zeros((height, width), np.int64), got["restart"] or height * width
    runs, reader = iter(_runs(scan)), None
    start = 0
    for i in range(height * width):
        y, x = divmod(i, width)
        if i % every == 0:
            reader, start = _Bits(next(runs)), y
        size = reader.symbol(table)
        diff = 1 << 15 if size == 16 else reader.number(size)
        if y == start:
            before = out[y, x - 1] if x else 1 << 7 - got["shift"]
        elif not x:
            before = out[y - 1, x]
        else:
            a, b, c = (int(v) for v in (out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]))
            before = (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) // 2)[kind - 1]
        out[y, x] = (before + diff) & 0xFFFF
    return (out << got["shift"]).astype(np.uint8)


def _baseline(got: dict, scan: bytes) -> np.ndarray:
    parts, high, wide = got["parts"], max(p[2] for p in got["parts"]), max(p[1] for p in got["parts"])
    one = len(parts) == 1
    blocks = (lambda p: (1, 1)) if one else (lambda p: (p[2], p[1]))
    rows, cols = (-(-got[k] // (8 * (1 if one else n))) for k, n in (("height", high), ("width", wide)))
    v, h = blocks(parts[0])
    out = np.zeros((rows * v * 8, cols * h * 8))
    runs, every, reader, dc = iter(_runs(scan)), got["restart"] or rows * cols, None, {}
    for mcu in range(rows * cols):
        if mcu % every == 0:
            reader, dc = _Bits(next(runs)), {p[0]: 0 for p in parts}
        for k, p in enumerate(parts):
            tables, quant = got["scan"][p[0]], got["quant"][p[3]]
            for j in range(blocks(p)[0] * blocks(p)[1]):
                block = np.zeros((8, 8))
                dc[p[0]] += reader.number(reader.symbol(got["huffman"][tables >> 4]))
                block[0, 0] = dc[p[0]] * quant[0]
                i = 1
                while i < 64:
                    symbol = reader.symbol(got["huffman"][16 | tables & 15])
                    if symbol == 0:
                        break
                    i += symbol >> 4
                    if symbol & 15 and i < 64:
                        block[ZIGZAG[i]] = reader.number(symbol & 15) * quant[i]
                    i += 1
                if k == 0:
                    y, x = (mcu // cols * v + j // h) * 8, (mcu % cols * h + j % h) * 8
                    out[y : y + 8, x : x + 8] = _COSINE @ block @ _COSINE.T
    return np.clip(np.round(out[: got["height"], : got["width"]] + 128), 0, 255).astype(np.uint8)


def luma(data: bytes) -> np.ndarray:
    """Samples (row, column) of one frame."""
    got, scan = _parse(data)
    if "kind" not in got:
        raise ValueError("a frame without a size")
    try:
        return _lossless(got, scan) if got["kind"] == 0xC3 else _baseline(got, scan)
    except (KeyError, StopIteration) as e:
        raise ValueError("a frame without its tables, or too short") from e
