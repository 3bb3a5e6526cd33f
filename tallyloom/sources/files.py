"""Files as tables: delimited text, folders, office packages, pixel tables, logs."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.inventory import visible
from tallyloom.session import ship_package

HASH_LIMIT = 200 * 1024 * 1024
LEAST_IMAGE = 5 * 1024


def delimiter_of(header: str) -> str:
    """Semicolon where the header has more of them than commas."""
    return ";" if header.count(";") > header.count(",") else ","


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """A delimited file with a header; the delimiter is read from the first line."""
    if delimiter is None:
        first = spark.read.text(path).head()
        delimiter = delimiter_of(first[0] if first else "")
    return spark.read.option("header", True).option("inferSchema", True).option("sep", delimiter).csv(path)


def write_delimited(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """df as delimited text with a header, without row numbers, in place of what is there."""
    df.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def write_log(rows: DataFrame, path: str) -> None:
    """Rows with status ok or skipped and a target, as semicolon-separated text whose header begins with a byte order mark."""
    kept = rows.where(F.col("status").isin("ok", "skipped") & F.col("target").isNotNull())
    first = kept.columns[0]
    kept.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("header", True).option("sep", ";").csv(path)


def pixel_table(wide: DataFrame, label: str = "label", prefix: str = "p") -> DataFrame:
    """label and px, an array, from one column per pixel in the order of their numbers."""
    names = sorted((c for c in wide.columns if re.fullmatch(f"{prefix}\\d+", c)), key=lambda c: int(c[len(prefix) :]))
    return wide.select(label, F.array(*[F.col(c).cast("double") for c in names]).alias("px"))


def wide_pixels(df: DataFrame, n: int, label: str = "label", px: str = "px", prefix: str = "p") -> DataFrame:
    return df.select(label, *[F.get(px, F.lit(k)).alias(f"{prefix}{k}") for k in range(n)])


def scan_folder(spark: SparkSession, root: str, hash_limit: int = HASH_LIMIT, with_hash: bool = True) -> DataFrame:
    """path, name, ext, size, modified, sha256 of the visible files below a folder.

    Contents are read only for the hash, and hashed only up to the limit; without
    a hash the content column is pruned. The source lists no files of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(re.sub(r"^file:/+", "/", root).rstrip("/") + "/")
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    rel = F.when(F.startswith(path, base), F.expr("substring(_p, length(_b) + 1)")).otherwise(path)
    found = files.withColumn("_p", path).withColumn("_b", base).withColumn("path", rel).where(visible(F.col("path")))
    name = F.element_at(F.split("path", "/"), -1)
    out = [F.col("path"), name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1)).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    if with_hash:
        out.append(F.when(F.col("length") <= hash_limit, F.sha2("content", 256)).alias("sha256"))
    return found.select(*out)


IMAGE = "path string, label string, n_rows int, n_columns int, samples int, pixels binary, error string"


def image_pixels(raw: bytes) -> tuple[int, int, int, bytes]:
    """(rows, columns, samples, bytes from the top left on) of an uncompressed bitmap (24 bits) or portable map (P5, P6)."""
    if raw[:2] == b"BM":
        start, _, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", raw, 10)
        if bits != 24 or packed or width <= 0 or not height:
            raise ValueError(f"bitmap of {bits} bits, compression {packed}")
        step, lines = (3 * width + 3) // 4 * 4, abs(height)
        if start + step * lines > len(raw):
            raise ValueError("a bitmap that is too short")
        rows = np.frombuffer(raw, np.uint8, step * lines, start).reshape(lines, step)[:, : 3 * width].reshape(lines, width, 3)
        return lines, width, 3, np.ascontiguousarray((rows[::-1] if height > 0 else rows)[:, :, ::-1]).tobytes()
    head = re.match(rb"(P5|P6)\s(?:#[^\n]*\n|\s)*(\d+)\s+(\d+)\s+(\d+)\s", raw)
    if not head or int(head[4]) > 255:
        raise ValueError("neither a bitmap nor a portable map")
    width, height, samples = int(head[2]), int(head[3]), 3 if head[1] == b"P6" else 1
    body = raw[head.end() : head.end() + width * height * samples]
    if len(body) < width * height * samples:
        raise ValueError("a portable map that is too short")
    return height, width, samples, body


def image_folder(spark: SparkSession, root: str) -> DataFrame:
    """IMAGE rows of the uncompressed pictures below a folder; the label is the name of the folder that a file is in.

    A file that can't be read gives a row with its error.
    """
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, raw in zip(b["path"], b["content"]):
                label = posixpath.basename(posixpath.dirname(path))
                try:
                    out.append((path, label, *image_pixels(bytes(raw)), None))
                except (ValueError, struct.error) as e:
                    out.append((path, label, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in IMAGE.split(", ")]).astype({"n_rows": "Int32", "n_columns": "Int32", "samples": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower("path").rlike(r"\.(bmp|pgm|ppm)$")).select("path", "content").mapInPandas(run, IMAGE)


def data_uri(content: Column, mime: str) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


# ---------------------------------------------------------------- office packages

NS = re.compile(r"\{[^}]*\}")


def _local(e: ET.Element) -> str:
    return NS.sub("", e.tag)


def _paragraphs(xml: bytes, paragraph: str, text: str | None) -> list[str]:
    """Text of each paragraph element; text: the element that holds it, or None for all text below."""
    out = []
    for p in ET.fromstring(xml).iter():
        if _local(p) == paragraph:
            s = "".join(p.itertext()) if text is None else "".join(t.text or "" for t in p.iter() if _local(t) == text)
            if s.strip():
                out.append(s.strip())
    return out


def xlsx_rows(raw: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """(sheet, row number, cells) of a workbook."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = z.namelist()
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ET.fromstring(z.read("xl/sharedStrings.xml")) if _local(si) == "si"]
    for sheet in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
        for k, row in enumerate(r for r in ET.fromstring(z.read(sheet)).iter() if _local(r) == "row"):
            cells: list[str | None] = []
            for c in (c for c in row if _local(c) == "c"):
                letters = re.match(r"[A-Z]+", c.get("r", "")) if c.get("r") else None
                if letters:
                    at = 0
                    for ch in letters[0]:
                        at = at * 26 + ord(ch) - 64
                    cells += [None] * (at - 1 - len(cells))
                value = next((v.text for v in c if _local(v) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                cells.append(value)
            yield posixpath.basename(sheet)[:-4], int(row.get("r", k + 1)), cells


#: Groups of rich text that hold no text of the document, and control words that stand for a character.
RTF_SKIPPED = frozenset(["fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "footnote", "listtable", "listoverridetable", "generator", "object", "themedata"])
RTF_MARKS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "cell": " | ", "row": "\n", "tab": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
RTF_TOKEN = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|[\r\n]|([^\\{}\r\n]+)", re.DOTALL)


def rtf_text(raw: bytes) -> str:
    """The plain text of rich text; groups may be left open."""
    if not raw.startswith(b"{\\rtf"):
        raise ValueError("no rich text")
    out: list[str] = []
    skipped, fallback, outer = False, 1, []  # whether this group is left out, characters that stand for the last \\u
    drop = 0
    for word, number, code, mark, brace, plain in RTF_TOKEN.findall(raw.decode("cp1252", "replace")):
        if brace == "{":
            outer.append((skipped, fallback))
        elif brace:
            skipped, fallback = outer.pop() if outer else (False, 1)
        elif word in RTF_SKIPPED or mark == "*":
            skipped = True
        elif word == "uc":
            fallback = int(number or 1)
        elif word == "u" and number:
            out += [] if skipped else [chr(int(number) % 65_536)]
            drop = fallback
        elif code or plain:
            text = bytes.fromhex(code).decode("cp1252", "replace") if code else plain
            out += [] if skipped else [text[drop:]]
            drop = max(0, drop - len(text))
        elif not skipped:
            out.append(RTF_MARKS.get(word, "") if word else {"~": "\u00a0", "_": "-", "\n": "\n", "\r": "\n"}.get(mark, mark if mark in "{}\\" else ""))
    return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def office_text(raw: bytes, ext: str) -> list[str]:
    """Paragraphs, slide texts or sheet rows of a document package, paragraphs of rich text."""
    if ext == ".rtf":
        return [s.strip() for s in rtf_text(raw).split("\n") if s.strip()]
    z = zipfile.ZipFile(io.BytesIO(raw))
    if ext == ".docx":
        return _paragraphs(z.read("word/document.xml"), "p", "t")
    if ext == ".pptx":
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        return [s for n in slides for s in _paragraphs(z.read(n), "p", "t")]
    if ext == ".xlsx":
        return [" | ".join(c or "" for c in cells) for _, _, cells in xlsx_rows(raw)]
    if ext in (".odt", ".odp", ".ods"):
        return _paragraphs(z.read("content.xml"), "p", None)
    raise ValueError(ext)


def embedded_images(raw: bytes, least: int = LEAST_IMAGE, most: int = 3) -> list[tuple[str, int]]:
    """The largest pictures inside a package that are not tiny."""
    found = [(i.filename, i.file_size) for i in zipfile.ZipFile(io.BytesIO(raw)).infolist() if re.search(r"(?i)(media|pictures)/[^/]+\.(png|jpe?g|gif|bmp|tiff?)$", i.filename) and i.file_size >= least]
    return sorted(found, key=lambda f: (-f[1], f[0]))[:most]


def office_excerpts(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, title, excerpt, n_images, status of office packages; other files and damaged ones get a status only."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, raw in zip(b["path"], b["content"]):
                ext = posixpath.splitext(p)[1].lower()
                try:
                    lines = office_text(bytes(raw or b""), ext)
                    images = [] if ext == ".rtf" else embedded_images(bytes(raw))
                    out.append((p, lines[0][:120] if lines else "", " | ".join(lines[:5])[:300], len(images), "ok" if lines else "leer"))
                except ValueError:
                    out.append((p, "", "", 0, "kein_extraktor"))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, IndexError):
                    out.append((p, "", "", 0, "fehler"))
            yield pd.DataFrame(out, columns=["path", "title", "excerpt", "n_images", "status"])

    rows = files.select(F.col(path).alias("path"), F.col(content).alias("content"))
    return rows.mapInPandas(run, "path string, title string, excerpt string, n_images long, status string")


def read_xlsx(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, sheet, row, cells of each workbook."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(p, *r) for p, raw in zip(b["path"], b["content"]) if raw is not None for r in xlsx_rows(bytes(raw))]
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "cells"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, sheet string, row long, cells array<string>")
