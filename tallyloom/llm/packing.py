"""Arrays as compact bytes, for rows that carry a whole block of values."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Integer arrays as byte planes, lowest byte first, compressed; planes of high zero bytes cost nothing."""
    parts = [struct.pack("<B", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        width = a.dtype.itemsize
        planes = a.view(np.uint8).reshape(len(a), width).T
        used = [k for k in range(width) if planes[k].any()] if len(a) else []
        body = np.ascontiguousarray(planes[: used[-1] + 1 if used else 0]).tobytes()
        small = zstandard.ZstdCompressor(level=level, write_checksum=False).compress(body) if len(body) > 32 else body
        if len(small) >= len(body):
            small = body
        parts.append(struct.pack("<2sIBBI", a.dtype.str[1:].encode(), len(a), used[-1] + 1 if used else 0, len(small) < len(body), len(small)))
        parts.append(small)
    return b"".join(parts)


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = memoryview(raw)
    out, at = [], 1
    for _ in range(raw[0]):
        kind, n, used, packed, size = struct.unpack_from("<2sIBBI", raw, at)
        at += struct.calcsize("<2sIBBI")
        body = raw[at : at + size]
        at += size
        if packed:
            body = zstandard.ZstdDecompressor().decompress(bytes(body), max_output_size=n * used)
        dtype = np.dtype("<" + kind.decode())
        planes = np.zeros((dtype.itemsize, n), np.uint8)
        planes[:used] = np.frombuffer(body, np.uint8).reshape(used, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n))
    return out


def pack_strings(items: list[bytes]) -> bytes:
    """Byte strings in order: their lengths and one run of bytes."""
    lengths = np.fromiter(map(len, items), np.uint32, len(items))
    return pack(lengths, np.frombuffer(b"".join(items), np.uint8))


def unpack_strings(raw: bytes) -> list[bytes]:
    lengths, data = unpack(raw)
    data = data.tobytes()
    ends = np.cumsum(lengths, dtype=np.int64).tolist()
    starts = [0, *ends[:-1]] if ends else []
    return [data[a:b] for a, b in zip(starts, ends)]
