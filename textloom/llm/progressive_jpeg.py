"""Progressive JPEG (ITU-T T.81) coefficient streams: a decoder for any progressive or its scans, and a lossless coefficient writer.

The decoder accumulates spectral-selection and successive-approximation scans into coefficient arrays, then dequantises,
inverse-transforms and upsamples in numpy. Scans whose symbols all have one length (as the writer below makes them) are read as
bit planes by whole arrays; any other scan goes through the bit-by-bit reader.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

_MARKER = re.compile(rb"\xff[^\0]")


@lru_cache(maxsize=1)
def zigzag() -> np.ndarray:
    """Natural index of each zigzag position, from the rule: diagonals, in alternating direction."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))
    return np.array([8 * r + c for r, c in order])


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    """The 64 x 64 matrix that takes dequantised coefficients in natural order to samples."""
    k = np.arange(8)
    one = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)[None, :]
    return np.kron(one, one).T.astype(np.float32)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    rows: int = 0  # blocks in a scan of this component alone
    cols: int = 0
    coefs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # padded to whole MCUs, zigzag order
    full: dict[tuple[int, int], bool] = field(default_factory=dict)  # bands without a zero, and whether all is positive


class Huffman:
    """A DHT table: codes by (length, code)."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        self.symbols, self.counts = symbols, counts
        code = k = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes[length, code] = symbols[k]
                code, k = code + 1, k + 1
            code <<= 1

    def single(self) -> int | None:
        """The symbol, if there is only one and its code is one bit long."""
        return self.symbols[0] if len(self.symbols) == 1 and self.counts[0] == 1 else None


class Bits:
    """Bits of an entropy-coded segment, stuffing removed."""

    def __init__(self, data: np.ndarray):
        self.bits = np.unpackbits(data)
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (s := table.codes.get((length, code))) is not None:
                return s
        raise ValueError("no such code")

    def signed(self, size: int) -> int:
        v = self.take(size)
        return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1


class Frame:
    """What the markers have told so far."""

    def __init__(self):
        self.width = self.height = 0
        self.components: list[Component] = []
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[tuple[int, int], Huffman] = {}
        self.comment = b""
        self.restart = 0

    def shape(self) -> tuple[int, int]:
        hm, vm = max(c.h for c in self.components), max(c.v for c in self.components)
        return -(-self.width // (8 * hm)), -(-self.height // (8 * vm))


def _start_frame(f: Frame, body: bytes) -> None:
    _, f.height, f.width, n = struct.unpack(">BHHB", body[:6])
    f.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    mx, my = f.shape()
    hm, vm = max(c.h for c in f.components), max(c.v for c in f.components)
    for c in f.components:
        c.cols, c.rows = -(-(-(-f.width * c.h // hm)) // 8), -(-(-(-f.height * c.v // vm)) // 8)
        c.coefs = np.zeros((my * c.v, mx * c.h, 64), np.int32)


def _dc_places(f: Frame, scan: list[Component]) -> list[tuple[Component, int, int]]:
    if len(scan) == 1:
        return [(scan[0], y, x) for y in range(scan[0].rows) for x in range(scan[0].cols)]
    mx, my = f.shape()
    return [(c, my_ * c.v + v, mx_ * c.h + h) for my_ in range(my) for mx_ in range(mx) for c in scan for v in range(c.v) for h in range(c.h)]


@lru_cache(maxsize=256)
def _planar_order(my: int, mx: int, factors: tuple[tuple[int, int], ...]) -> list[np.ndarray]:
    """Where the blocks of each component, in its own raster order, stand in an interleaved scan."""
    per, at, out = sum(h * v for h, v in factors), 0, []
    mcu = (np.arange(my)[:, None] * mx + np.arange(mx)[None, :]) * per
    for h, v in factors:
        inner = at + np.arange(v)[:, None] * h + np.arange(h)[None, :]
        out.append((mcu[:, None, :, None] + inner[None, :, None, :]).reshape(my * v, mx * h))
        at += h * v
    return out


def _order(f: Frame, scan: list[Component]) -> list[np.ndarray]:
    if len(scan) == 1:
        return [np.arange(scan[0].rows * scan[0].cols).reshape(scan[0].rows, scan[0].cols)]
    mx, my = f.shape()
    factors = tuple((c.h, c.v) for c in scan)
    return (_planar_order if mx * my <= 4096 else _planar_order.__wrapped__)(my, mx, factors)


def _scan(f: Frame, head: bytes, data: np.ndarray) -> None:
    n = head[0]
    ids = {c.ident: c for c in f.components}
    scan = [ids[head[1 + 2 * i]] for i in range(n)]
    dc = {c.ident: head[2 + 2 * i] >> 4 for i, c in enumerate(scan)}
    ac = {c.ident: head[2 + 2 * i] & 15 for i, c in enumerate(scan)}
    ss, se, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    bits = Bits(data)
    if ss == 0:
        order = _order(f, scan)
        total = sum(o.size for o in order)
        if high or all(f.tables[0, dc[c.ident]].single() == 0 for c in scan):  # one bit a block
            raw = bits.bits[:total].astype(np.int32)
            if len(raw) < total:
                raise ValueError("scan ends early")
            if high:
                for c, o in zip(scan, order):
                    c.coefs[: o.shape[0], : o.shape[1], 0] |= raw[o] << low
            return
        last = dict.fromkeys(dc, 0)
        for c, y, x in _dc_places(f, scan):
            last[c.ident] += bits.signed(bits.symbol(f.tables[0, dc[c.ident]]))
            c.coefs[y, x, 0] = last[c.ident] << low
        return
    (c,) = scan
    table, band = f.tables[1, ac[c.ident]], c.coefs[: c.rows, : c.cols, ss : se + 1]
    blocks, width = c.rows * c.cols, se - ss + 1
    if not high and table.single() == 1 and width > 0:  # every coefficient new, of size 1: a code bit and a sign bit each
        signs = bits.bits[1 : 2 * blocks * width : 2]
        c.full[ss, se] = bool(signs.all())
        band[...] = 1 << low if c.full[ss, se] else np.where(signs, 1 << low, -(1 << low)).reshape(band.shape)
        return
    if high and (ss, se) in c.full and _raw_refinement(band, bits, table, low, blocks, width, c.full[ss, se]):
        return
    (_refine if high else _first)(band.reshape(blocks, width) if band.flags.c_contiguous else band, bits, table, low, c)


def _raw_refinement(band: np.ndarray, bits: Bits, table: Huffman, low: int, blocks: int, width: int, positive: bool) -> bool:
    """Correction bits only: runs of block ends that cover all blocks. False, with nothing done, if there is anything else."""
    start, done, parts = bits.at, 0, []
    while done < blocks:
        s = bits.symbol(table)
        if s & 15 or s >> 4 == 15:
            bits.at = start
            return False
        run = (1 << (s >> 4)) + bits.take(s >> 4)
        parts.append(bits.bits[bits.at : bits.at + run * width])
        bits.at += run * width
        done += run
    add = (parts[0] if len(parts) == 1 else np.concatenate(parts)).reshape(band.shape).astype(np.int32) << low
    band += add if positive else np.where(band > 0, add, -add)
    return True


def _blocks(band: np.ndarray, c: Component):
    flat = band.ndim == 2
    for i in range(c.rows * c.cols):
        yield band[i] if flat else band[i // c.cols, i % c.cols]


def _first(band: np.ndarray, bits: Bits, table: Huffman, low: int, c: Component) -> None:
    run = 0
    for block in _blocks(band, c):
        if run:
            run -= 1
            continue
        k, width = 0, len(block)
        while k < width:
            s = bits.symbol(table)
            r, size = s >> 4, s & 15
            if size == 0:
                if r < 15:
                    run = (1 << r) + bits.take(r) - 1
                    break
                k += 16
                continue
            k += r
            block[k] = bits.signed(size) * (1 << low)
            k += 1


def _refine(band: np.ndarray, bits: Bits, table: Huffman, low: int, c: Component) -> None:
    step, run = 1 << low, 0

    def correct(block, k):
        if bits.take(1):
            block[k] += step if block[k] > 0 else -step

    for block in _blocks(band, c):
        k, width = 0, len(block)
        while k < width and not run:
            s = bits.symbol(table)
            r, size = s >> 4, s & 15
            if size == 0 and r < 15:
                run = (1 << r) + bits.take(r)
                break
            new = (step if bits.take(1) else -step) if size else 0
            while k < width:
                if block[k]:
                    correct(block, k)
                elif r == 0:
                    break
                else:
                    r -= 1
                k += 1
            if size and k < width:
                block[k] = new
            k += 1
        if run:
            for j in range(k, width):
                if block[j]:
                    correct(block, j)
            run -= 1


def decode(data: bytes) -> Frame:
    """All scans of a progressive file, accumulated."""
    f, at = Frame(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while True:
        marker = data[at + 1]
        if marker == 0xD9:
            return f
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC2:
            _start_frame(f, body)
        elif marker in (0xC0, 0xC1):
            raise ValueError("sequential, not progressive")
        elif marker == 0xFE:
            f.comment = body
        elif marker == 0xDD and body != b"\0\0":
            raise ValueError("restart intervals are not supported")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                f.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                f.tables[body[0] >> 4, body[0] & 15] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDA:
            end = _MARKER.search(data, at).start()
            _scan(f, body, np.frombuffer(data[at:end].replace(b"\xff\0", b"\xff"), np.uint8))
            at = end


def to_rgb(f: Frame) -> np.ndarray:
    """The full-resolution height x width x 3 tensor of unsigned bytes; subsampled components are upsampled by repetition."""
    hm, vm = max(c.h for c in f.components), max(c.v for c in f.components)
    planes = []
    for c in f.components:
        rows, cols, _ = c.coefs.shape
        natural = np.empty((rows * cols, 64), np.float32)
        natural[:, zigzag()] = c.coefs.reshape(-1, 64) * f.quant[c.table]
        samples = (natural @ _cosines()).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
        planes.append(samples.repeat(vm // c.v, 0).repeat(hm // c.h, 1)[: f.height, : f.width])
    y = planes[0] + 128
    if len(planes) == 1:
        rgb = np.stack([y] * 3, -1)
    else:
        cb, cr = planes[1], planes[2]
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.rint(np.clip(rgb, 0, 255)).astype(np.uint8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _entropy(bits: np.ndarray) -> bytes:
    pad = -len(bits) % 8
    return np.packbits(np.concatenate((bits, np.ones(pad, np.uint8))) if pad else bits).tobytes().replace(b"\xff", b"\xff\0")


#: The largest side of a JPEG in blocks of 4:2:0 MCUs, and blocks in a run of block ends.
MAX_SIDE, MAX_RUN = 65535 // 16, 32767
PLANES = 8


def encode_bytes(payload: bytes, quant: int = 1) -> bytes:
    """A progressive 4:2:0 file whose quantised coefficients hold the payload: DC = byte, AC = 256 + byte, as bit planes.

    A first scan tells each AC coefficient's leading bit and sign, and a refinement scan each lower bit; DC goes likewise. The
    comment holds the payload's length, as the last MCU may be filled up with zero bytes.
    """
    mcus = max(1, -(-len(payload) // 384))
    mx = min(mcus, MAX_SIDE)
    my = -(-mcus // mx)
    if my > MAX_SIDE:
        raise ValueError("payload too large for one image")
    values = np.zeros(my * mx * 384, np.uint8)
    values[: len(payload)] = np.frombuffer(payload, np.uint8)
    luma = values[: my * mx * 256].reshape(my * 2 * mx * 2, 64)
    chroma = values[my * mx * 256 :].reshape(2, my * mx, 64)
    comps = [luma, chroma[0], chroma[1]]
    one = lambda ident, symbol: bytes([ident]) + b"\1" + bytes(15) + bytes([symbol])  # noqa: E731  a table of a single one-bit code
    ends = bytes([0x11]) + b"\0\0\0\x08" + b"\x07" + bytes(11) + bytes(s << 4 for s in range(15))  # 15 symbols: runs of block ends
    out = [
        b"\xff\xd8", _segment(0xFE, b"payload " + str(len(payload)).encode()), _segment(0xDB, b"\0" + bytes([quant]) * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, my * 16, mx * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(0xC4, one(0x00, 0) + one(0x10, 1) + ends),
    ]
    # DC: blocks in MCU order, four of luma and one of each chroma.
    y = luma[:, 0].reshape(my, 2, mx, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    dc = np.concatenate((y, chroma[0, :, :1], chroma[1, :, :1]), 1).ravel()
    dc_head = bytes([3, 1, 0, 2, 0, 3, 0, 0, 0])
    out += [_segment(0xDA, dc_head + bytes([PLANES])), _entropy(np.zeros(len(dc), np.uint8))]
    planes = np.unpackbits(dc[:, None], axis=1)
    for p in range(PLANES):
        low = PLANES - 1 - p
        out += [_segment(0xDA, dc_head + bytes([(low + 1) << 4 | low])), _entropy(planes[:, p])]
    for ident, c in enumerate(comps, 1):
        n = len(c)
        first = np.zeros((n * 63, 2), np.uint8)
        first[:, 1] = 1
        out += [_segment(0xDA, bytes([1, ident, 0, 1, 63, PLANES])), _entropy(first.ravel())]
        planes = np.unpackbits(np.ascontiguousarray(c[:, 1:]).reshape(-1, 1), axis=1)
        for p in range(PLANES):
            low = PLANES - 1 - p
            parts = []
            for a in range(0, n, MAX_RUN):
                run = min(MAX_RUN, n - a)
                s = run.bit_length() - 1
                code = [int(x) for x in f"{s:04b}"] if s < 8 else [int(x) for x in f"{16 + s - 8:05b}"]
                extra = [int(x) for x in f"{run - (1 << s):0{s}b}"] if s else []
                parts += [np.array(code + extra, np.uint8), planes[a * 63 : (a + run) * 63, p]]
            out += [_segment(0xDA, bytes([1, ident, 1, 1, 63, (low + 1) << 4 | low])), _entropy(np.concatenate(parts))]
    return b"".join((*out, b"\xff\xd9"))


def payload_of(f: Frame) -> bytes:
    """The bytes that encode_bytes has put into the coefficients."""
    values = []
    for c in f.components:
        v = c.coefs.reshape(-1, 64).copy()
        v[:, 1:] -= 256
        values.append(v.astype(np.uint8).ravel())
    return np.concatenate(values).tobytes()[: int(f.comment.split()[1])]
