"""Length-delimited binary records with masked CRC-32C checksums (the TFRecord framing), and their offset index.

Record: length (unsigned 64-bit), masked checksum of the length's bytes, data, masked checksum of the data; little-endian.
Index: a header, then for each record its document id, its offset in the record file and its number of ids, 64-bit each.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

_POLYNOMIAL = 0x82F63B78  # Castagnoli, reflected
_MASK_DELTA = 0xA282EAD8
BLOCK = 256
INDEX_MAGIC = b"TLIX0001"
INDEX_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<i8"), ("n_tokens", "<i8")])


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Slicing tables for four bytes at a time, and tables that carry a state over BLOCK zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1).astype(np.uint32)
    slices = [t]
    for _ in range(3):
        slices.append(t[slices[-1] & 255] ^ (slices[-1] >> 8))
    carry = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for _ in range(BLOCK):
        carry = t[carry & 255] ^ (carry >> 8)
    return np.stack(slices), carry.astype(np.uint32)


def crc32c_scalar(data: bytes) -> int:
    t, state = _tables()[0][0], 0xFFFFFFFF
    for byte in data:
        state = int(t[(state ^ byte) & 255]) ^ (state >> 8)
    return state ^ 0xFFFFFFFF


def crc32c_many(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part, all parts at once: blocks side by side, then folded part by part."""
    out = np.zeros(len(parts), np.uint32)
    long = [i for i, p in enumerate(parts) if len(p) >= 4]
    for i in (i for i, p in enumerate(parts) if len(p) < 4):
        out[i] = crc32c_scalar(parts[i])
    if not long:
        return out
    slices, carry = _tables()
    sizes = np.array([len(parts[i]) for i in long], np.int64)
    blocks = -(-sizes // BLOCK)
    ends = np.cumsum(blocks) * BLOCK
    buf = np.zeros(int(ends[-1]), np.uint8)
    for i, size, end in zip(long, sizes.tolist(), ends.tolist()):
        buf[end - size : end] = np.frombuffer(parts[i], np.uint8)  # leading zeros leave a zero state alone
    starts = ends - sizes
    buf[(starts[:, None] + np.arange(4)).ravel()] ^= 0xFF  # the initial state of ones
    words = np.ascontiguousarray(buf.view("<u4").reshape(-1, BLOCK // 4).T)
    state = np.zeros(words.shape[1], np.uint32)
    for w in words:
        state ^= w
        state = slices[3][state & 255] ^ slices[2][(state >> 8) & 255] ^ slices[1][(state >> 16) & 255] ^ slices[0][state >> 24]
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    total = state[first]
    order = np.argsort(-blocks, kind="stable")
    for k in range(1, int(blocks.max())):
        act = order[: np.searchsorted(-blocks[order], -k)]
        s = total[act]
        total[act] = carry[0][s & 255] ^ carry[1][(s >> 8) & 255] ^ carry[2][(s >> 16) & 255] ^ carry[3][s >> 24] ^ state[first[act] + k]
    out[long] = total ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    return (((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_DELTA)).astype(np.uint32)


def frame(parts: list[bytes]) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in parts]
    heads, bodies = masked(crc32c_many(lengths)), masked(crc32c_many(parts))
    return [b"".join((n, h.tobytes(), p, b.tobytes())) for n, h, p, b in zip(lengths, heads.astype("<u4"), parts, bodies.astype("<u4"))]


class CorruptRecord(ValueError):
    """A checksum or a length doesn't fit."""


def unframe(stream, batch_bytes: int = 4 << 20):
    """Lists of records' data from a binary stream, each checksum verified."""
    at, parts, heads, bodies, size = 0, [], [], [], 0

    def verified():
        lengths = [struct.pack("<Q", len(p)) for p in parts]
        for crcs, what in ((heads, lengths), (bodies, parts)):
            if not np.array_equal(masked(crc32c_many(what)), np.array(crcs, np.uint32)):
                raise CorruptRecord(f"checksum mismatch before byte {at}")
        return parts

    while head := stream.read(12):
        if len(head) < 12:
            raise CorruptRecord(f"file ends within a record's head at byte {at}")
        length, crc = struct.unpack("<QI", head)
        if int(masked(crc32c_many([head[:8]]))[0]) != crc if length > 1 << 32 else False:
            raise CorruptRecord(f"bad length at byte {at}")
        data, tail = stream.read(length), stream.read(4)
        if len(data) < length or len(tail) < 4:
            raise CorruptRecord(f"file ends within a record at byte {at}")
        at += 16 + length
        parts.append(data)
        heads.append(crc)
        bodies.append(struct.unpack("<I", tail)[0])
        size += length + 64
        if size >= batch_bytes:
            yield verified()
            parts, heads, bodies, size = [], [], [], 0
    if parts:
        yield verified()
