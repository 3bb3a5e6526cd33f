"""Keywords in the metadata of files: read, merged, written back with the rest of each file as it was.

Documents (docx, pptx, xlsx, pdf) keep the keywords they have; pictures (png, jpeg)
get new ones and a description. A file goes through a task by itself: nothing is
shuffled, and no list of files is held. Null contents, unknown kinds and damaged files
are rows with a status.
"""

from __future__ import annotations

import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tallyloom.session import ship_package
from tallyloom.sources.folder import opened, register
from tallyloom.store import store

PACKAGES, PICTURES = (".docx", ".pptx", ".xlsx"), (".png", ".jpg", ".jpeg")
KINDS = (*PACKAGES, *PICTURES, ".pdf")
#: What a function of files gives, to Spark and to Arrow.
FILE = ("binary", pa.binary())
METADATA = ("struct<keywords:string,description:string,status:string>", pa.struct({"keywords": pa.string(), "description": pa.string(), "status": pa.string()}))
REWRITTEN = ("struct<content:binary,keywords:string,status:string>", pa.struct({"content": pa.binary(), "keywords": pa.string(), "status": pa.string()}))
RUN_BYTES = 1 << 20  # of results that a task gathers before it hands them on
FAULTS = (ValueError, KeyError, IndexError, struct.error, zipfile.BadZipFile, ET.ParseError, zlib.error)

# ---------------------------------------------------------------- office packages

#: Names of the package format.
CORE, RELATIONS, TYPES = "docProps/core.xml", "_rels/.rels", "[Content_Types].xml"
SPACES = {
    "cp": "http://schemas.openxmlformats.org/package/2006/metadata/core-properties",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "dcmitype": "http://purl.org/dc/dcmitype/",
    "xsi": "http://www.w3.org/2001/XMLSchema-instance",
}
RELATION = "http://schemas.openxmlformats.org/package/2006/relationships"
CORE_RELATION = "http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties"
OFFICE_RELATION = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
TYPE_SPACE = "http://schemas.openxmlformats.org/package/2006/content-types"
CORE_TYPE = "application/vnd.openxmlformats-package.core-properties+xml"
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
WORD_SPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
for _prefix, _uri in SPACES.items():
    ET.register_namespace(_prefix, _uri)


def package_metadata(raw: bytes) -> tuple[str, str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        if CORE not in z.namelist():
            return "", ""
        root = ET.fromstring(z.read(CORE))
    return root.findtext(f"{{{SPACES['cp']}}}keywords") or "", root.findtext(f"{{{SPACES['dc']}}}description") or ""


def _with_child(xml: bytes, root: bytes, child: bytes) -> bytes:
    """A part of the package with one more element at the end of its root."""
    end = re.search(rb"</(\w+:)?" + root + rb"\s*>\s*$", xml)
    if not end:
        raise ValueError("no root")
    return xml[: end.start()] + b"<" + (end[1] or b"") + child + b"/>" + xml[end.start() :]


def package_with(raw: bytes, keywords: str) -> bytes:
    """The package with these keywords; a part for them, its type and relation are added where it has none. Other parts are copied."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as made:
        names = z.namelist()
        core = ET.fromstring(z.read(CORE)) if CORE in names else ET.Element(f"{{{SPACES['cp']}}}coreProperties")
        name = f"{{{SPACES['cp']}}}keywords"
        entry = core.find(name)
        (entry if entry is not None else ET.SubElement(core, name)).text = keywords
        new = {CORE: ET.tostring(core, encoding="UTF-8", xml_declaration=True)}
        if CORE not in names:
            new[TYPES] = _with_child(z.read(TYPES), b"Types", f'Override PartName="/{CORE}" ContentType="{CORE_TYPE}"'.encode())
            new[RELATIONS] = _with_child(z.read(RELATIONS), b"Relationships", f'Relationship Id="rIdCore" Type="{CORE_RELATION}" Target="{CORE}"'.encode())
        for info in z.infolist():
            made.writestr(info, new.pop(info.filename) if info.filename in new else z.read(info))
        for left, data in new.items():
            made.writestr(zipfile.ZipInfo(left), data)
    return out.getvalue()


# ---------------------------------------------------------------- PNG

PNG = b"\x89PNG\r\n\x1a\n"


def png_chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    if not raw.startswith(PNG):
        raise ValueError("no PNG")
    at, kind = len(PNG), b""
    while kind != b"IEND":
        n, kind = struct.unpack_from(">I4s", raw, at)
        if at + 12 + n > len(raw):
            raise ValueError("cut short")
        yield kind, raw[at + 8 : at + 8 + n]
        at += 12 + n


def png_chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_text(kind: bytes, data: bytes) -> tuple[str, str] | None:
    """(key, value) of a text chunk of any of the three kinds."""
    if kind not in (b"tEXt", b"zTXt", b"iTXt"):
        return None
    key, rest = data.split(b"\0", 1)
    if kind == b"tEXt":
        value = rest.decode("latin-1")
    elif kind == b"zTXt":
        value = zlib.decompress(rest[1:]).decode("latin-1")
    else:
        body = rest[2:].split(b"\0", 2)[2]
        value = (zlib.decompress(body) if rest[0] else body).decode()
    return key.decode("latin-1"), value


def png_metadata(raw: bytes) -> tuple[str, str]:
    texts = dict(t for t in (png_text(*c) for c in png_chunks(raw)) if t)
    return texts.get("Keywords", ""), texts.get("Description", "")


def png_with(raw: bytes, keywords: str, description: str) -> bytes:
    """The picture with both texts before its samples; every other chunk is copied."""
    made = []
    for key, value in (("Keywords", keywords), ("Description", description)):
        try:
            made.append(png_chunk(b"tEXt", key.encode() + b"\0" + value.encode("latin-1")))
        except UnicodeEncodeError:
            made.append(png_chunk(b"iTXt", key.encode() + b"\0\0\0\0\0" + value.encode()))
    out = [PNG]
    for kind, data in png_chunks(raw):
        text = png_text(kind, data)
        if text and text[0] in ("Keywords", "Description"):
            continue
        if kind in (b"IDAT", b"IEND"):
            out += made
            made = []
        out.append(png_chunk(kind, data))
    return b"".join(out)


# ---------------------------------------------------------------- JPEG

EXIF, DESCRIPTION_TAG, KEYWORDS_TAG = b"Exif\0\0", 270, 40092
VALUE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def jpeg_segments(raw: bytes) -> tuple[list[tuple[int, bytes]], bytes]:
    """(marker and payload of the segments before the samples, what follows)."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, out = 2, []
    while True:
        if raw[at] != 0xFF:
            raise ValueError("no marker")
        if raw[at + 1] == 0xFF:  # a fill byte
            at += 1
            continue
        if raw[at + 1] in (0xDA, 0xD9):
            return out, raw[at:]
        n = struct.unpack_from(">H", raw, at + 2)[0]
        if n < 2 or at + 2 + n > len(raw):
            raise ValueError("cut short")
        out.append((raw[at + 1], raw[at + 4 : at + 2 + n]))
        at += 2 + n


def exif_entries(tiff: bytes) -> tuple[str, list[tuple[int, bytes]], int]:
    """(byte order, tag and raw entry of each field of the first directory, offset of the next directory)."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        raise ValueError("no byte order")
    at = struct.unpack_from(order + "I", tiff, 4)[0]
    n = struct.unpack_from(order + "H", tiff, at)[0]
    raw = [tiff[at + 2 + 12 * k : at + 14 + 12 * k] for k in range(n)]
    return order, [(struct.unpack(order + "H", e[:2])[0], e) for e in raw], struct.unpack_from(order + "I", tiff, at + 2 + 12 * n)[0]


def exif_value(tiff: bytes, order: str, entry: bytes) -> bytes:
    _, kind, count, where = struct.unpack(order + "HHII", entry)
    n = VALUE_BYTES[kind] * count
    return entry[8 : 8 + n] if n <= 4 else tiff[where : where + n]


def jpeg_metadata(raw: bytes) -> tuple[str, str]:
    for marker, data in jpeg_segments(raw)[0]:
        if marker == 0xE1 and data.startswith(EXIF):
            order, entries, _ = exif_entries(data[6:])
            held = {tag: exif_value(data[6:], order, e) for tag, e in entries if tag in (DESCRIPTION_TAG, KEYWORDS_TAG)}
            return held.get(KEYWORDS_TAG, b"").decode("utf-16-le", "ignore").rstrip("\0"), held.get(DESCRIPTION_TAG, b"").decode("utf-8", "replace").rstrip("\0")
    return "", ""


def jpeg_with(raw: bytes, keywords: str, description: str) -> bytes:
    """The picture with both fields. The first directory is written anew behind the old block, so that offsets in other fields stay true; samples are copied."""
    segments, rest = jpeg_segments(raw)
    at = next((k for k, (m, d) in enumerate(segments) if m == 0xE1 and d.startswith(EXIF)), None)
    tiff = segments[at][1][6:] if at is not None else struct.pack("<2sHIHI", b"II", 42, 8, 0, 0)
    order, entries, following = exif_entries(tiff)
    fields = {tag: e for tag, e in entries}
    block = tiff + b"\0" * (len(tiff) % 2)
    for tag, kind, value in ((DESCRIPTION_TAG, 2, description.encode() + b"\0"), (KEYWORDS_TAG, 1, keywords.encode("utf-16-le"))):
        head = struct.pack(order + "HHI", tag, kind, len(value))
        if len(value) <= 4:
            fields[tag] = head + value.ljust(4, b"\0")
        else:
            fields[tag] = head + struct.pack(order + "I", len(block))
            block += value + b"\0" * (len(value) % 2)
    start = len(block)
    block += struct.pack(order + "H", len(fields)) + b"".join(fields[t] for t in sorted(fields)) + struct.pack(order + "I", following)
    payload = EXIF + block[:4] + struct.pack(order + "I", start) + block[8:]
    if len(payload) > 65_533:
        raise ValueError("longer than a segment")
    if at is None:
        at = 1 if segments and segments[0][0] == 0xE0 else 0  # behind the first segment of the plain format
        segments.insert(at, (0xE1, payload))
    else:
        segments[at] = (0xE1, payload)
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, m, len(d) + 2) + d for m, d in segments) + rest


# ---------------------------------------------------------------- PDF

PDF_WORD = re.compile(rb"\s*(<<|>>|\[|\]|/[^\s/<>\[\]()%{}]*|<[0-9A-Fa-f\s]*>|\(|[^\s/<>\[\]()%{}]+)")
PDF_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|[\s\S]))")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_word(raw: bytes, at: int) -> tuple[bytes, int]:
    """A token and its end; a string in brackets is one token."""
    m = PDF_WORD.match(raw, at)
    if not m:
        raise ValueError("no token")
    if m[1] != b"(":
        return m[1], m.end()
    depth, k = 1, m.end()
    while depth:
        c = raw[k]  # beyond the end: IndexError, a damaged file
        k += 2 if c == 0x5C else 1
        depth += (c == 0x28) - (c == 0x29)
    return raw[m.end() - 1 : k], k


def pdf_dictionary(raw: bytes, at: int) -> dict[bytes, bytes]:
    """Names and raw values of the dictionary at a place."""
    word, at = pdf_word(raw, at)
    if word != b"<<":
        raise ValueError("no dictionary")
    out: dict[bytes, bytes] = {}
    key, at = pdf_word(raw, at)
    while key != b">>":
        value, at = pdf_word(raw, at)
        words, depth = [value], (value in (b"<<", b"[")) - (value in (b">>", b"]"))
        while True:
            word, end = pdf_word(raw, at)
            if depth == 0 and (word == b">>" or word.startswith(b"/")):
                break
            depth += (word in (b"<<", b"[")) - (word in (b">>", b"]"))
            words.append(word)
            at = end
        out[key] = b" ".join(words)
        key, at = word, end
    return out


def pdf_string(value: bytes) -> str:
    if value.startswith(b"<"):
        digits = re.sub(rb"\s", b"", value[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        plain = lambda m: bytes([int(m[1], 8) & 255]) if m[1] else b"" if m[2] in (b"\n", b"\r", b"\r\n") else ESCAPES.get(m[2], m[2])
        data = PDF_ESCAPE.sub(plain, value[1:-1])
    return data[2:].decode("utf-16-be", "replace") if data.startswith(b"\xfe\xff") else data.decode("latin-1")


def pdf_info(raw: bytes) -> tuple[dict[bytes, bytes], dict[bytes, bytes], int]:
    """(the last trailer, the information dictionary, where the last table of objects is)."""
    if not raw.startswith(b"%PDF"):
        raise ValueError("no PDF")
    start = int(re.match(rb"startxref\s+(\d+)", raw[raw.rindex(b"startxref") :])[1])
    trailer, at, seen, offsets = None, start, set(), {}
    while at not in seen:
        seen.add(at)
        if not raw.startswith(b"xref", at):
            raise ValueError("objects are listed in a stream")
        word, at = pdf_word(raw, at + 4)
        while word != b"trailer":
            first, (n, at) = int(word), pdf_word(raw, at)
            for number in range(first, first + int(n)):
                where, at = pdf_word(raw, at)
                _, at = pdf_word(raw, at)
                used, at = pdf_word(raw, at)
                offsets.setdefault(number, int(where) if used == b"n" else None)
            word, at = pdf_word(raw, at)
        ends = pdf_dictionary(raw, at)
        trailer = trailer or ends
        at = int(ends.get(b"/Prev", b"%d" % start))
    if b"/Encrypt" in trailer:
        raise ValueError("encrypted")
    if b"/Info" not in trailer:
        return trailer, {}, start
    where = offsets[int(trailer[b"/Info"].split()[0])]
    head = re.compile(rb"\s*\d+\s+\d+\s+obj").match(raw, -1 if where is None else where)
    if not head:
        raise ValueError("no information object")
    return trailer, pdf_dictionary(raw, head.end()), start


def pdf_metadata(raw: bytes) -> tuple[str, str]:
    _, info, _ = pdf_info(raw)
    return tuple(pdf_string(info[k]) if k in info else "" for k in (b"/Keywords", b"/Subject"))


def pdf_with(raw: bytes, keywords: str) -> bytes:
    """The file with an update behind its end: a new information object, its place and a trailer. The subject is the start of the keywords."""
    trailer, info, start = pdf_info(raw)
    size = int(trailer[b"/Size"])
    number, generation = (map(int, trailer[b"/Info"].split()[:2])) if b"/Info" in trailer else (size, 0)
    shown = lambda s: b"<" + (b"\xfe\xff" + s.encode("utf-16-be", "replace")).hex().encode() + b">"
    info |= {b"/Keywords": shown(keywords), b"/Subject": shown(keywords[:120])}
    trailer |= {b"/Size": b"%d" % max(size, number + 1), b"/Info": b"%d %d R" % (number, generation), b"/Prev": b"%d" % start}
    flat = lambda d: b"<< " + b" ".join(k + b" " + v for k, v in d.items()) + b" >>"
    body = raw if raw.endswith(b"\n") else raw + b"\n"
    placed = b"%d %d obj\n%s\nendobj\n" % (number, generation, flat(info))
    table = b"xref\n%d 1\n%010d %05d n \ntrailer\n%s\n" % (number, len(body), generation, flat(trailer))
    return body + placed + table + b"startxref\n%d\n%%%%EOF\n" % (len(body) + len(placed))


# ---------------------------------------------------------------- columns


def metadata_of(raw: bytes | None, ext: str | None) -> tuple[str | None, str | None, str]:
    if ext in KINDS and raw is None:
        return None, None, "fehlt"
    try:
        data = bytes(raw or b"")
        if ext in PACKAGES:
            return (*package_metadata(data), "ok")
        if ext == ".pdf":
            return (*pdf_metadata(data), "ok")
        if ext in PICTURES:
            return (*(png_metadata if ext == ".png" else jpeg_metadata)(data), "ok")
    except FAULTS:
        return None, None, "fehler"
    return None, None, "kein_metadatenfeld"


def rewritten(raw: bytes | None, ext: str | None, keywords: str, description: str | None) -> tuple[bytes | None, str]:
    if ext in KINDS and raw is None:
        return None, "fehlt"
    try:
        data = bytes(raw or b"")
        if ext in PACKAGES:
            return package_with(data, keywords), "ok"
        if ext == ".pdf":
            return pdf_with(data, keywords), "ok"
        if ext in PICTURES:
            return (png_with if ext == ".png" else jpeg_with)(data, keywords, description or keywords), "ok"
    except FAULTS:
        return raw, "fehler"
    return raw, "kein_metadatenfeld"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def trimmed(words: list[str | None]) -> list[str]:
    """The words without white space around them, each once, in their order."""
    return list(dict.fromkeys(w for w in ((x or "").strip(" \t\r\n") for x in words) if w))


def merged_keywords(ext: str | None, stored: str | None, new: list[str | None] | None) -> str:
    """The keywords that a file gets: of a document the sorted union of old and new, in the given order where it has none; of a picture the new ones."""
    old, add = trimmed((stored or "").split(",")), trimmed(new or [])
    return ", ".join(add if ext in PICTURES or not old else sorted({*old, *add}))


def with_keywords(raw: bytes | None, ext: str | None, new: list[str | None] | None, description: str | None) -> tuple[bytes | None, str | None, str]:
    """(file with old and new keywords, these, status); no keywords where it can't be written."""
    words = merged_keywords(ext, None if ext in PICTURES else metadata_of(raw, ext)[0], new)
    content, status = rewritten(raw, ext, words, description)
    return content, words if status == "ok" else None, status


def one_by_one(f: Callable, kind: tuple[str, pa.DataType]) -> Callable:
    """f(a row's values) as a function of columns, called file by file.

    Results leave in runs of some RUN_BYTES: a function of whole batches would hold
    10,000 files, before and after it.
    """

    @F.arrow_udf(kind[0])
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            made, held = [], 0
            for row in zip(*columns):
                made.append(f(*(x.as_py() for x in row)))
                held += sum(len(x) for x in (made[-1] if isinstance(made[-1], tuple) else made[-1:]) if x) + 64
                if held > RUN_BYTES:
                    yield pa.array(made, kind[1])
                    made, held = [], 0
            yield pa.array(made, kind[1])

    return run


def read_keywords(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, keywords, description, status of each file; null texts where the status isn't ok."""
    ship_package(files.sparkSession)
    held = one_by_one(metadata_of, METADATA)
    rows = files.select(F.col(path).alias("path"), held(F.col(content), extension(F.col(path))).alias("m"))
    return rows.select("path", "m.keywords", "m.description", "m.status")


def write_keywords(files: DataFrame, path: str = "path", content: str = "content", new: str = "new", description: str | None = None) -> DataFrame:
    """files with the array `new` in the metadata of each, and in pictures the description (the keywords where it is null or empty).

    Content is replaced; keywords, as written, and status are added (a column of such a
    name gives way). A file that can't be written keeps its content, and has no keywords here.
    """
    ship_package(files.sparkSession)
    put = one_by_one(with_keywords, REWRITTEN)
    told = F.col(description) if description else F.lit(None).cast("string")
    rows = files.withColumn("__kw_put", put(F.col(content), extension(F.col(path)), F.col(new).cast("array<string>"), told))
    kept = [F.col(f"`{c}`") for c in files.columns if c not in (content, "keywords", "status")]
    return rows.select(*kept, F.col("__kw_put.content").alias(content), "__kw_put.keywords", "__kw_put.status")


def with_contents(paths: DataFrame, root: str) -> DataFrame:
    """paths with `content`: the file of each path within a folder, null where there is none or the kind has no metadata. Tasks open what they need, one file at a time."""
    ship_package(paths.sparkSession)

    def run(batches):
        store_, base = opened(root)
        for batch in batches:
            for k, path in enumerate(batch.column(batch.schema.get_field_index("path")).to_pylist()):
                inside = posixpath.normpath(path or ".")
                raw = None
                if posixpath.splitext(inside)[1].lower() in KINDS and not inside.startswith(("/", "../")):
                    try:
                        with store_.open_input_stream(posixpath.join(base, inside)) as file:
                            raw = file.read()
                    except FileNotFoundError:
                        pass
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([raw], pa.binary())], names=[*batch.schema.names, "content"])

    return paths.mapInArrow(run, StructType([*paths.schema.fields, StructField("content", BinaryType())]))


def keyword_folder(spark: SparkSession, root: str, proposed: DataFrame) -> DataFrame:
    """path, keywords, description, status as read from the files of a folder, once the keywords in `proposed` (path within the folder, new, and perhaps description) are written to them.

    Only proposed files are opened, and no content is shuffled; of rows with one path,
    the one with the least keywords counts. A path without a file is "fehlt". A run
    that broke off can be repeated: a union of keywords stays the same.
    """
    register(spark)
    told = F.col("description") if "description" in proposed.columns else F.lit(None).cast("string")
    least = F.min(F.struct(F.coalesce("new", F.array().cast("array<string>")).alias("new"), told.alias("told")))
    wanted = store(proposed.where("path is not null").groupBy("path").agg(least.alias("w")).select("path", "w.*"), "proposed").df
    written = write_keywords(with_contents(wanted, root), description="told").where("status = 'ok'")
    written.select("path", "content").write.format("file_folder").option("path", root).mode("append").save()
    return read_keywords(with_contents(wanted.select("path"), root))


# ---------------------------------------------------------------- texts as files


def text_file(text: str | None, ext: str | None) -> bytes | None:
    """A whole text as a document of its paragraphs, a page's stream of a PDF, or a picture whose samples are its bytes."""
    data = (text or "").encode("utf-8", "replace")
    if ext == ".docx":
        out = io.BytesIO()
        shown = "".join(f"<w:p><w:r><w:t>{escape(re.sub(r'[^\t\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]', '', s))}</w:t></w:r></w:p>" for s in (text or "").split("\n"))
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, xml in (
                (TYPES, f'<Types xmlns="{TYPE_SPACE}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{WORD_TYPE}"/></Types>'),
                (RELATIONS, f'<Relationships xmlns="{RELATION}"><Relationship Id="rId1" Type="{OFFICE_RELATION}" Target="word/document.xml"/></Relationships>'),
                ("word/document.xml", f'<w:document xmlns:w="{WORD_SPACE}"><w:body>{shown}</w:body></w:document>'),
            ):
                info = zipfile.ZipInfo(name)
                info.compress_type = zipfile.ZIP_DEFLATED
                z.writestr(info, xml)
        return out.getvalue()
    if ext == ".png":
        high = max(1, -(-len(data) // 64))
        rows = data.ljust(high * 64, b"\0")
        samples = b"".join(b"\0" + rows[k : k + 64] for k in range(0, len(rows), 64))
        return PNG + png_chunk(b"IHDR", struct.pack(">IIBBBBB", 64, high, 8, 0, 0, 0, 0)) + png_chunk(b"IDAT", zlib.compress(samples)) + png_chunk(b"IEND", b"")
    if ext == ".pdf":
        stream = zlib.compress(data)
        parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /PieceInfo << /Text << /Private 4 0 R >> >> >>", b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(stream), stream)]
        out, places = b"%PDF-1.4\n", []
        for k, p in enumerate(parts, 1):
            places.append(len(out))
            out += b"%d 0 obj\n%s\nendobj\n" % (k, p)
        table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(parts) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
        return out + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, len(out))
    return None


def text_files(texts: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """texts with `content`: each text as a file of its path's kind (docx, pdf, png); null for other kinds."""
    ship_package(texts.sparkSession)
    return texts.withColumn("content", one_by_one(text_file, FILE)(F.col(text), extension(F.col(path))))


def text_keywords(texts: DataFrame, new: list[str], path: str = "path", text: str = "text", description: str | None = None) -> DataFrame:
    """read_keywords() of text_files() that the array of each column in `new` is written to by turns, with the description the last time.

    A file goes through all of it at once, so that no content is handed from step to step.
    """
    ship_package(texts.sparkSession)

    def steps(body: str | None, ext: str | None, told: str | None, *words: list[str | None] | None) -> tuple[str | None, str | None, str]:
        raw = text_file(body, ext)
        for k, add in enumerate(words, 1):
            raw = with_keywords(raw, ext, add, told if k == len(words) else None)[0]
        return metadata_of(raw, ext)

    told = F.col(description) if description else F.lit(None).cast("string")
    read = one_by_one(steps, METADATA)(F.col(text), extension(F.col(path)), told, *[F.col(c).cast("array<string>") for c in new])
    return texts.select(F.col(path).alias("path"), read.alias("m")).select("path", "m.keywords", "m.description", "m.status")
