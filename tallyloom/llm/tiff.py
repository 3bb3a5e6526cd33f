"""TIFF pages: directories, PackBits, LZW and deflate, strips and tiles, predictors."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.textkit import buffers
from tallyloom.session import ship_package

#: Fixed values of the format: tag numbers, field sizes by type, compression codes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
FILL_ORDER, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 266, 284, 317, 322, 323, 324, 325, 339
FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, DEFLATE_OLD, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257
#: Most bytes that one stored byte can stand for: a run of 128 in two, the longest LZW entry in 12 bits, deflate's longest match in two bits.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 2560, DEFLATE: 1032, DEFLATE_OLD: 1032}
READ = frozenset((WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, FILL_ORDER, PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT))
#: Largest page that is decoded, in bytes of samples.
PAGE_BYTES = 1 << 28


class BadTiff(ValueError):
    """The bytes are no readable TIFF."""


# ---------------------------------------------------------------- codecs


def packbits_encode(raw: bytes) -> bytes:
    """Runs of three or more equal bytes become two bytes, the rest literals of up to 128."""
    data = np.frombuffer(raw, np.uint8)
    out = bytearray()
    if not len(data):
        return b""
    edge = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]]))
    lengths = np.diff(np.append(edge, len(data)))
    at = 0

    def literal(lo: int, hi: int) -> None:
        for k in range(lo, hi, 128):
            part = raw[k : min(hi, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    long = np.flatnonzero(lengths >= 3)
    for start, n in zip(edge[long].tolist(), lengths[long].tolist()):
        literal(at, start)
        value = raw[start]
        at = start + n
        while n > 1:
            k = min(128, n)
            out += bytes((257 - k, value))
            n -= k
        if n:
            at -= 1
    literal(at, len(raw))
    return bytes(out)


def packbits_decode(raw: bytes, size: int) -> bytes:
    out, at, n = bytearray(), 0, len(raw)
    while at < n and len(out) < size:
        k = raw[at]
        if k < 128:
            out += raw[at + 1 : at + 2 + k]
            at += 2 + k
        elif k > 128:
            if at + 1 >= n:
                raise BadTiff("PackBits run without its byte")
            out += raw[at + 1 : at + 2] * (257 - k)
            at += 2
        else:
            at += 1
    return bytes(out)


def _widths(n: int) -> np.ndarray:
    """Bits of each of n codes that follow a clear code: a code is one bit wider from table sizes 511, 1023 and 2047 on."""
    k = np.arange(n)
    return 9 + (k >= 254).astype(np.int64) + (k >= 766) + (k >= 1790)


#: Codes between two clear codes; the table is never fuller than 4094 entries.
LZW_BLOCK = 3836


def lzw_encode(raw: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, early change of the width."""
    blocks, codes, table, fresh, prefix = [], [], {}, 258, -1
    put = codes.append
    for b in raw:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        known = table.get(key)
        if known is not None:
            prefix = known
        else:
            put(prefix)
            table[key] = fresh
            fresh += 1
            prefix = b
            if fresh == LZW_BLOCK + 258:
                blocks.append(codes)
                codes, table, fresh = [], {}, 258
                put = codes.append
    if prefix >= 0:
        put(prefix)
    blocks.append(codes)
    values, widths = [], []
    for k, block in enumerate(blocks):
        tail = [END] if k == len(blocks) - 1 else []
        body = np.array(block + tail + ([CLEAR] if not tail else []), np.int64)
        if k == 0:
            values.append(np.array([CLEAR], np.int64))
            widths.append(np.array([9], np.int64))
        values.append(body)
        widths.append(_widths(len(body)))
    v, w = np.concatenate(values), np.concatenate(widths)
    bits = (v[:, None] >> (11 - np.arange(12))) & 1
    keep = np.arange(12) >= (12 - w)[:, None]
    return np.packbits(bits[keep].astype(np.uint8)).tobytes()


def lzw_decode(raw: bytes, size: int) -> bytes:
    """Codes are cut out block by block, since widths follow from the count since the last clear code."""
    padded = np.frombuffer(raw + b"\0\0\0", np.uint8).astype(np.int64)
    triples = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    total, at, out, made = len(raw) * 8, 0, [], 0
    if total >= 9 and (int(triples[0]) >> 15) == CLEAR:
        at = 9
    root = [bytes((k,)) for k in range(256)] + [b"", b""]
    while at < total and made < size:
        widths = _widths(LZW_BLOCK + 260)
        starts = at + np.concatenate([[0], np.cumsum(widths)[:-1]])
        fits = starts + widths <= total
        starts, w = starts[fits], widths[fits]
        codes = triples[starts >> 3] >> (24 - w - (starts & 7)) & ((1 << w) - 1)
        stop = np.flatnonzero((codes == CLEAR) | (codes == END))
        n = int(stop[0]) if len(stop) else len(codes)
        table, size_of_table = root[:], 258
        block = codes[:n].tolist()
        if block and block[0] > 255:
            raise BadTiff("LZW block begins with a code above 255")
        last = table[block[0]] if block else b""
        entries = [last]
        add, put = table.append, entries.append
        for c in block[1:]:
            if c < size_of_table:
                entry = table[c]
                add(last + entry[:1])
            elif c == size_of_table:
                entry = last + last[:1]
                add(entry)
            else:
                raise BadTiff("LZW code beyond the table")
            size_of_table += 1
            put(entry)
            last = entry
        out += entries
        made += sum(map(len, entries))
        if n == len(codes) or codes[n] == END:
            break
        at = int(starts[n] + w[n])
    return b"".join(out)


def decompress(raw: bytes, code: int, size: int) -> bytes:
    if code == NONE:
        return raw
    if code == PACKBITS:
        return packbits_decode(raw, size)
    if code == LZW:
        return lzw_decode(raw, size)
    if code in (DEFLATE, DEFLATE_OLD):
        try:
            return zlib.decompressobj().decompress(raw, size)
        except zlib.error as e:
            raise BadTiff(f"deflate: {e}") from None
    raise BadTiff(f"compression {code}")


def compress(raw: bytes, code: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 6)}[code](raw)


def difference(block: np.ndarray) -> np.ndarray:
    """Predictor 2 on (rows, columns, samples)."""
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def undo_predictor(block: np.ndarray, predictor: int, byte_order: str) -> np.ndarray:
    """block: (rows, columns, samples); 1: none, 2: horizontal differences, 3: floating point."""
    if predictor == 1:
        return block
    if predictor == 2:
        bits = block.view(f"{byte_order}u{block.dtype.itemsize}") if block.dtype.kind == "f" else block  # differences of floats are those of their bits
        return np.cumsum(bits, axis=1, dtype=bits.dtype).astype(bits.dtype).view(block.dtype)  # a sum is in native order
    if predictor == 3 and block.dtype.kind == "f":
        rows, columns, samples = block.shape
        width = block.dtype.itemsize
        raw = np.ascontiguousarray(block).view(np.uint8).reshape(rows, -1, samples)
        planes = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, width, columns * samples)
        big = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{width}").reshape(rows, columns, samples)
        return big.astype(f"{byte_order}f{width}")
    raise BadTiff(f"predictor {predictor} of {block.dtype.kind}{8 * block.dtype.itemsize}")


# ---------------------------------------------------------------- files


def directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of each image directory, in file order; a loop in the chain ends it.

    Only the tags that decoding needs are read. A directory whose values take more
    room than the file has is no directory.
    """
    if len(raw) < 8 or raw[:2] not in (b"II", b"MM"):
        raise BadTiff("no TIFF header")
    order = "<" if raw[:2] == b"II" else ">"
    magic = struct.unpack_from(order + "H", raw, 2)[0]
    if magic not in (42, 43):
        raise BadTiff(f"magic {magic}")
    big = magic == 43
    count_type, entry, offset_type = ("Q", "HHQ", "Q") if big else ("H", "HHI", "I")
    inline, step = (8, 20) if big else (4, 12)
    try:
        at = struct.unpack_from(order + offset_type, raw, 8 if big else 4)[0]
        seen = set()
        while at and at not in seen:
            seen.add(at)
            n = struct.unpack_from(order + count_type, raw, at)[0]
            at += struct.calcsize(count_type)
            if n * step > len(raw):
                raise BadTiff("a directory beyond the end of the file")
            tags, taken = {}, 0
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + entry, raw, at + k * step)
                field = FIELD.get(kind)
                if field is None or tag not in READ:
                    continue
                where, size = at + k * step + step - inline, struct.calcsize("=" + field) * count
                taken += size
                if taken > len(raw):
                    raise BadTiff("a directory with more values than the file holds")
                if size > inline:
                    where = struct.unpack_from(order + offset_type, raw, where)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{field}", raw, where)
            yield order, tags
            at = struct.unpack_from(order + offset_type, raw, at + n * step)[0]
    except (struct.error, OverflowError) as e:
        raise BadTiff(str(e)) from None


def whole(tags: dict[int, tuple], tag: int, default: int | None = None) -> int:
    """The first value of a tag, a number that is not negative; its default where it has none."""
    value = (tags.get(tag) or (default,))[0]
    if not isinstance(value, int) or value < 0:
        raise BadTiff(f"tag {tag}: {'missing' if value is None else 'no whole number'}")
    return value


def unpack_bits(part: bytes, rows: int, values: int, bits: int) -> np.ndarray:
    """(rows, values) samples of 1, 2 or 4 bits, highest bits first; each row begins at a byte."""
    wide = -(-values * bits // 8)
    flags = np.unpackbits(np.frombuffer(part, np.uint8, rows * wide).reshape(rows, wide), axis=1)[:, : values * bits]
    weights = (1 << np.arange(bits)[::-1]).astype(np.uint8)
    return (flags.reshape(rows, values, bits) * weights).sum(axis=2, dtype=np.uint8)


def read_page(raw: bytes, order: str, tags: dict[int, tuple], page_bytes: int = PAGE_BYTES) -> np.ndarray:
    """Samples (rows, columns, samples per pixel) of one directory.

    Samples have 1, 2, 4 (as 8), 8, 16, 32 or 64 bits. Nothing is allocated before the
    sizes are known to fit what the file holds and `page_bytes`.
    """
    columns, rows = whole(tags, WIDTH), whole(tags, LENGTH)
    samples, bits, code = whole(tags, SAMPLES, 1), whole(tags, BITS, 1), whole(tags, COMPRESSION, NONE)
    predictor, planar, form = whole(tags, PREDICTOR, 1), whole(tags, PLANAR, 1), whole(tags, SAMPLE_FORMAT, 1)
    if not (columns and rows and samples):
        raise BadTiff("a page without samples")
    small = bits in (1, 2, 4)
    if not small and bits not in (8, 16, 32, 64) or form not in (1, 2, 3) or form == 3 and bits < 16 or small and (form != 1 or predictor != 1) or any(b != bits for b in tags.get(BITS, ())):
        raise BadTiff(f"{bits} bits, format {form}, predictor {predictor}")
    if whole(tags, FILL_ORDER, 1) != 1 or code not in EXPANSION:
        raise BadTiff(f"compression {code}, fill order {whole(tags, FILL_ORDER, 1)}")
    dtype = np.dtype(np.uint8) if small else np.dtype(f"{order}{'uif'[form - 1]}{bits // 8}")
    tiled = TILE_OFFSETS in tags
    offsets, counts = (tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ()))
    if len(offsets) != len(counts) or not all(isinstance(x, int) and 0 <= x <= len(raw) for x in (*offsets, *counts)):
        raise BadTiff("offsets and byte counts of strips or tiles that don't fit")
    high = whole(tags, TILE_LENGTH, rows) if tiled else min(whole(tags, ROWS_PER_STRIP, rows), rows)
    wide = whole(tags, TILE_WIDTH, columns) if tiled else columns
    if not high or not wide:
        raise BadTiff("an empty strip or tile")
    across, down = -(-columns // wide), -(-rows // high)
    planes = samples if planar == 2 else 1
    each = 1 if planar == 2 else samples
    cells = across * down * planes
    if len(offsets) < cells:
        raise BadTiff("too few strips or tiles")
    row_bytes = -(-wide * each * bits // 8)
    least = row_bytes * across * planes * (high * down if tiled else rows)
    if least > EXPANSION[code] * sum(counts[:cells]):
        raise BadTiff("a page larger than its strips or tiles can hold")
    if max(rows * columns * samples, high * wide * each) * dtype.itemsize > page_bytes:
        raise BadTiff(f"a page of more than {page_bytes} bytes")
    out = np.zeros((rows, columns, samples), dtype.newbyteorder("="))
    for k in range(cells):
        plane, cell = divmod(k, across * down)
        y, x = cell // across * high, cell % across * wide
        r = high if tiled else min(high, rows - y)
        part = decompress(raw[offsets[k] : offsets[k] + counts[k]], code, r * row_bytes)
        if len(part) < r * row_bytes:
            raise BadTiff("a strip or tile is too short")
        block = (unpack_bits(part, r, wide * each, bits) if small else np.frombuffer(part, dtype, r * wide * each)).reshape(r, wide, each)
        block = undo_predictor(block, predictor, order)
        target = out[y : y + high, x : x + wide, plane : plane + 1] if planar == 2 else out[y : y + high, x : x + wide]
        target[:] = block[: target.shape[0], : target.shape[1]]
    return out


@dataclass(frozen=True)
class Layout:
    """How a page is stored; tile: (rows, columns), multiples of 16, or None for strips."""

    compression: int = DEFLATE
    predictor: int = 1
    tile: tuple[int, int] | None = None
    rows_per_strip: int = 128


def write_tiff(pages: list[np.ndarray], layouts: Sequence[Layout] = (Layout(),), order: str = "<") -> bytes:
    """Grey or multi-sample pages of unsigned integers as one file; the layouts take turns."""
    out = bytearray(b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)
    link = 4
    for number, page in enumerate(pages):
        page = page[:, :, None] if page.ndim == 2 else page
        rows, columns, samples = page.shape
        layout = layouts[number % len(layouts)]
        compression, predictor, tile = layout.compression, layout.predictor, layout.tile
        high, wide = tile or (layout.rows_per_strip, columns)
        offsets, counts = [], []
        for y in range(0, rows, high):
            for x in range(0, columns, wide):
                block = page[y : y + high, x : x + wide]
                if tile and block.shape[:2] != (high, wide):
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = difference(block)
                part = compress(block.astype(block.dtype.newbyteorder(order)).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(part))
                out += part
        tags = [(WIDTH, 4, [columns]), (LENGTH, 4, [rows]), (BITS, 3, [page.dtype.itemsize * 8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [wide]), (TILE_LENGTH, 4, [high]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [high]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(tags):
            body = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(body) > 4:
                where = len(out)
                out += body + b"\0" * (len(body) & 1)
                body = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        out += b"\0" * (len(out) & 1)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


# ---------------------------------------------------------------- operators

PAGE_SCHEMA = "page int, n_rows int, n_columns int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, mean double, error string"


def page_rows(raw: bytes | None, page_bytes: int = PAGE_BYTES) -> Iterator[dict]:
    """A dict of PAGE_SCHEMA for each page; a file or page that can't be read gives one row with its error."""
    k = 0
    try:
        for order, tags in directories(raw or b""):
            base = {"page": k, "tiled": TILE_OFFSETS in tags}
            try:
                base |= {"compression": min(whole(tags, COMPRESSION, NONE), (1 << 31) - 1), "predictor": min(whole(tags, PREDICTOR, 1), (1 << 31) - 1)}
                pixels = read_page(raw, order, tags, page_bytes)
                yield base | {"n_rows": pixels.shape[0], "n_columns": pixels.shape[1], "samples": pixels.shape[2], "bits": pixels.dtype.itemsize * 8, "pixels": pixels.tobytes(), "mean": float(pixels.mean()) if pixels.size else 0.0, "error": None}
            except (ValueError, IndexError, TypeError, OverflowError, MemoryError, struct.error) as e:  # BadTiff is a ValueError
                yield base | {"error": str(e) or type(e).__name__}
            k += 1
    except BadTiff as e:
        yield {"page": k, "error": str(e)}


def tiff_pages(files: DataFrame, key: str = "path", content: str = "content", page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One row per page of each TIFF file: key and PAGE_SCHEMA.

    Null, empty or damaged content gives one row with `error` set and null
    samples, and so does each page that can't be decoded or whose samples would
    take more than `page_bytes`; pages before it are kept. A file without pages
    gives no row, an empty table an empty one; repeated rows and keys, null ones
    too, are decoded alike. Other columns are dropped, so names can't clash. No
    shuffle: each file is decoded where it is read.
    """
    ship_package(files.sparkSession)
    kind = dict(files.dtypes)[key]
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                for rows in ([row] for row in page_rows(batch.column(1)[k].as_py(), page_bytes)):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(rows), batch.schema.field(0).type)] + [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=["key", *names])

    types = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.float64(), pa.string()]
    out = files.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"key {kind}, {PAGE_SCHEMA}")
    return out.withColumnRenamed("key", key)


#: Production layout of stored payloads: 64 samples a row; pages of up to 4096 rows take turns with the layouts.
COLUMNS, PAGE_ROWS = 64, 4096
LAYOUTS = (Layout(PACKBITS), Layout(LZW, 2), Layout(DEFLATE, 2, (16, 32)))


def store_payload(payload: bytes, layouts: Sequence[Layout] = LAYOUTS) -> bytes:
    """A payload of a positive multiple of 64 bytes as 8-bit grey pages.

    The rows are cut into pages of about equal height, at least as many as there are
    layouts, so every payload of three rows or more is stored in all of them.
    """
    grey = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    pages = min(len(grey), max(len(layouts), -(-len(grey) // PAGE_ROWS)))
    return write_tiff(np.array_split(grey, pages), layouts)


FEATURE_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages long"


def document_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Every text as a stored TIFF, read back page by page (FEATURE_SCHEMA).

    Null and empty texts are 64 zero bytes; a text of any length is one file. `feature`
    is pages:rows:mean in thousandths:XOR of the samples as 64-bit numbers, from what
    was read back. Repeated rows give equal values, a null id stays null, extra
    columns are ignored, an empty table gives an empty one. No shuffle.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column(1))
            rows = []
            for k in range(batch.num_rows):
                raw = data[off[k] : off[k + 1]].tobytes()
                media = store_payload(raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), layouts)
                pages = list(page_rows(media))
                if any(p["error"] for p in pages):
                    raise BadTiff(next(p["error"] for p in pages if p["error"]))
                back = b"".join(p["pixels"] for p in pages)
                total = sum(p["n_rows"] for p in pages)
                grey = np.frombuffer(back, np.uint64).reshape(total, 8)
                fold = int(np.bitwise_xor.reduce(grey.ravel())) if total else 0
                mean = int(np.frombuffer(back, np.uint8).sum(dtype=np.int64)) * 1000 // len(back)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(pages)}:{total}:{mean}:{fold:016x}", len(pages)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()])] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=[x.split()[0] for x in FEATURE_SCHEMA.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, FEATURE_SCHEMA)
