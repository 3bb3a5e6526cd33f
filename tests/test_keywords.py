import io
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import keywords as K
from tallyloom.sources.folder import register

WORDS = "Übung, größer, 日本"


def chunks(raw):
    return [c for c in K.png_chunks(raw) if K.png_text(*c) is None]


def test_package_keeps_its_other_parts():
    raw = K.text_file("erste Zeile\n<zwei> & \x00drei", ".docx")
    once = K.package_with(raw, "b, a")
    twice = K.package_with(once, WORDS)
    assert K.package_metadata(raw) == ("", "") and K.package_metadata(once) == ("b, a", "") and K.package_metadata(twice)[0] == WORDS
    parts = lambda r: {n: zipfile.ZipFile(io.BytesIO(r)).read(n) for n in zipfile.ZipFile(io.BytesIO(r)).namelist()}
    assert sorted(parts(once)) == sorted([*parts(raw), K.CORE]) == sorted(parts(twice))
    assert parts(twice)["word/document.xml"] == parts(raw)["word/document.xml"]
    assert K.CORE_TYPE in parts(once)[K.TYPES].decode() and K.CORE_RELATION in parts(once)[K.RELATIONS].decode()
    assert parts(once)[K.TYPES] == parts(twice)[K.TYPES]
    for part in parts(twice).values():
        K.ET.fromstring(part)


def test_package_core_keeps_title_and_dates():
    core = f'<cp:coreProperties xmlns:cp="{K.SPACES["cp"]}" xmlns:dc="{K.SPACES["dc"]}" xmlns:dcterms="{K.SPACES["dcterms"]}" xmlns:xsi="{K.SPACES["xsi"]}"><dc:title>T</dc:title><dc:description>D</dc:description><cp:keywords>alt</cp:keywords><dcterms:created xsi:type="dcterms:W3CDTF">2024-01-01T00:00:00Z</dcterms:created></cp:coreProperties>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(K.CORE, core)
        z.writestr("ppt/presentation.xml", "<p/>")
    made = K.package_with(out.getvalue(), "neu")
    assert K.package_metadata(made) == ("neu", "D")
    after = zipfile.ZipFile(io.BytesIO(made)).read(K.CORE).decode()
    assert ">T<" in after and 'xsi:type="dcterms:W3CDTF"' in after and "2024-01-01" in after and 'xmlns:dcterms="' in after


@pytest.mark.parametrize("words", ["a, b", WORDS, ""])
def test_png_samples_and_other_texts_stay(words):
    raw = K.text_file("Zeile " * 50, ".png")
    head = len(K.PNG) + 25
    raw = raw[:head] + K.png_chunk(b"tEXt", b"Author\0wer") + K.png_chunk(b"zTXt", b"Keywords\0\0" + zlib.compress(b"alt")) + raw[head:]
    assert K.png_metadata(raw) == ("alt", "")
    made = K.png_with(raw, words, "Bild")
    assert K.png_metadata(made) == (words, "Bild") and chunks(made) == chunks(raw)
    assert ("Author", "wer") in [K.png_text(*c) for c in K.png_chunks(made)]
    assert sum(1 for c in K.png_chunks(made) if (K.png_text(*c) or ("",))[0] == "Keywords") == 1
    assert K.png_metadata(K.png_with(made, "x", "y")) == ("x", "y")


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, m, len(d) + 2) + d for m, d in segments) + b"\xff\xda\x00\x02samples\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_jpeg_other_fields_and_samples_stay(order):
    # A maker's name behind the directory, an orientation within its entry, a next directory.
    tiff = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8) + struct.pack(order + "H", 3)
    tiff += struct.pack(order + "HHII", 270, 2, 3, 0)[:8] + b"ab\0\0"
    tiff += struct.pack(order + "HHII", 271, 2, 6, 50) + struct.pack(order + "HHIHH", 274, 3, 1, 6, 0) + struct.pack(order + "I", 0) + b"Marke\0"
    assert tiff[50:] == b"Marke\0"
    raw = jpeg((0xE0, b"JFIF\0rest"), (0xE1, K.EXIF + tiff), (0xDB, b"table"))
    assert K.jpeg_metadata(raw) == ("", "ab")
    made = K.jpeg_with(K.jpeg_with(raw, "eins", "x"), WORDS, "größer")
    assert K.jpeg_metadata(made) == (WORDS, "größer")
    segments, rest = K.jpeg_segments(made)
    assert rest == b"\xff\xda\x00\x02samples\xff\xd9" and [m for m, _ in segments] == [0xE0, 0xE1, 0xDB]
    block = segments[1][1][6:]
    _, entries, _ = K.exif_entries(block)
    assert [t for t, _ in entries] == [270, 271, 274, 40092]
    assert K.exif_value(block, order, dict(entries)[271]) == b"Marke\0" and K.exif_value(block, order, dict(entries)[274]) == struct.pack(order + "H", 6)


def test_jpeg_without_exif():
    made = K.jpeg_with(jpeg((0xE0, b"JFIF\0"), (0xDB, b"t")), "a", "b")
    assert K.jpeg_metadata(made) == ("a", "b") and [m for m, _ in K.jpeg_segments(made)[0]] == [0xE0, 0xE1, 0xDB]
    assert K.jpeg_metadata(K.jpeg_with(jpeg(), "a", "b")) == ("a", "b")
    with pytest.raises(ValueError):
        K.jpeg_with(jpeg(), "a" * 40_000, "b")


def test_pdf_updates_follow_the_file():
    raw = K.text_file("Seite", ".pdf")
    once = K.pdf_with(raw, "a, b")
    twice = K.pdf_with(once, WORDS)
    assert K.pdf_metadata(raw) == ("", "") and K.pdf_metadata(once) == ("a, b", "a, b") and K.pdf_metadata(twice) == (WORDS, WORDS)
    assert once.startswith(raw) and twice.startswith(once)
    trailer, info, start = K.pdf_info(twice)
    assert trailer[b"/Size"] == b"6" and trailer[b"/Root"] == b"1 0 R" and twice[start : start + 4] == b"xref"
    assert len(K.pdf_metadata(K.pdf_with(raw, "x" * 300))[1]) == 120


def test_pdf_strings_and_other_entries():
    info = rb"<< /Title (a \(b\) \\ (c) \101\n) /Keywords <FEFF00E4> /Trapped /True /Odd [1 << /K (>>) >> 2] /Ref 3 0 R >>"
    raw = b"%PDF-1.4\n1 0 obj\n" + info + b"\nendobj\n"
    at = len(raw)
    raw += b"xref\n0 2\n0000000000 65535 f \n0000000009 00000 n \ntrailer\n<< /Size 2 /Info 1 0 R /ID [<00> <01>] >>\nstartxref\n%d\n%%%%EOF" % at
    assert K.pdf_metadata(raw) == ("ä", "")
    _, made, _ = K.pdf_info(K.pdf_with(raw, "neu"))
    assert K.pdf_string(made[b"/Title"]) == "a (b) \\ (c) A\n" and made[b"/Trapped"] == b"/True" and made[b"/Ref"] == b"3 0 R"
    assert made[b"/Odd"] == b"[ 1 << /K (>>) >> 2 ]" and K.pdf_info(K.pdf_with(raw, "neu"))[0][b"/ID"] == b"[ <00> <01> ]"
    for bad in (raw.replace(b"xref\n0 2", b"5 0 obj "), raw.replace(b"/Size 2", b"/Encrypt 9 0 R /Size 2"), raw[:30], b"%PDF-1.4 startxref 999"):
        assert K.metadata_of(bad, ".pdf") == (None, None, "fehler")


def test_columns_merge_write_and_read(spark):
    rows = [
        ("a/x.DOCX", "Text", ["c", " a ", "", "c", None], "egal"),
        ("a/y.pdf", "", None, None),
        ("z.png", None, ["neu"], "Bild"),
        ("n.png", "t", ["neu"], ""),
        ("q.txt", "t", ["neu"], None),
        ("ohne", None, ["neu"], None),
    ]
    files = K.text_files(spark.createDataFrame(rows, "path string, text string, new array<string>, about string"))
    once = K.write_keywords(files.withColumn("status", F.lit(7)), description="about")
    got = {r.path: r for r in once.collect()}
    assert got["a/x.DOCX"].keywords == "c, a" and got["a/y.pdf"].keywords == "" and got["z.png"].keywords == "neu"
    assert got["q.txt"].status == "kein_metadatenfeld" and got["q.txt"].keywords is None and got["q.txt"].content is None
    more = once.withColumn("new", F.array(F.lit("b"), F.lit("a")))
    read = {r.path: (r.keywords, r.description, r.status) for r in K.read_keywords(K.write_keywords(more, description="about")).collect()}
    assert read["a/x.DOCX"] == ("a, b, c", "", "ok") and read["a/y.pdf"] == ("b, a", "b, a", "ok")
    assert read["z.png"] == ("b, a", "Bild", "ok") and read["n.png"] == ("b, a", "b, a", "ok") and read["ohne"] == (None, None, "kein_metadatenfeld")


def test_damaged_files_are_rows(spark):
    rows = [(f"{k}{ext}", raw) for ext in (".docx", ".pdf", ".png", ".jpg", ".pptx", ".xlsx", ".jpeg") for k, raw in enumerate([None, b"", b"PK\x03\x04", b"%PDF-1.4", K.PNG, b"\xff\xd8\xff"])]
    files = spark.createDataFrame(rows, "path string, content binary").withColumn("new", F.array(F.lit("a")))
    got = K.write_keywords(files).collect()
    assert {(r.content is None, r.status) for r in got} == {(True, "fehlt"), (False, "fehler")} and {(r.path, r.content and bytes(r.content)) for r in got} == {(p, c or c) for p, c in rows}
    assert sorted(r.status for r in K.read_keywords(files).collect()) == ["fehler"] * 35 + ["fehlt"] * 7
    assert K.read_keywords(files.limit(0)).count() == 0


def test_folder_is_rewritten_file_by_file(spark, tmp_path):
    register(spark)
    rows = [("a/x.docx", "eins"), ("a/b/ü y.png", "zwei"), ("z.pdf", None), ("q.txt", "drei"), ("still.docx", "vier")]
    files = K.text_files(spark.createDataFrame(rows, "path string, text string"))
    more = spark.createDataFrame([("q.txt", b"plain"), (None, b"x"), ("none.bin", None)], "path string, content binary")
    files.select("path", "content").unionByName(more).write.format("file_folder").option("path", str(tmp_path)).mode("append").save()
    seen = {str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()}
    assert seen == {r[0] for r in rows} and (tmp_path / "q.txt").read_bytes() == b"plain"
    still = (tmp_path / "still.docx").stat().st_mtime_ns
    proposed = spark.createDataFrame([("a/x.docx", ["k"]), ("a/x.docx", ["b"]), ("a/b/ü y.png", ["p"]), ("z.pdf", None), ("q.txt", ["k"]), ("weg.docx", ["k"]), (None, ["k"])], "path string, new array<string>")
    want = {("a/x.docx", "b", "", "ok"), ("a/b/ü y.png", "p", "p", "ok"), ("z.pdf", "", "", "ok"), ("q.txt", None, None, "kein_metadatenfeld"), ("weg.docx", None, None, "fehlt")}
    assert K.keyword_folder(spark, str(tmp_path), proposed.limit(0)).count() == 0
    for _ in range(2):
        assert {tuple(r) for r in K.keyword_folder(spark, str(tmp_path), proposed).collect()} == want
    assert K.package_metadata((tmp_path / "a/x.docx").read_bytes()) == ("b", "") and (tmp_path / "still.docx").stat().st_mtime_ns == still
    assert K.png_metadata((tmp_path / "a/b/ü y.png").read_bytes()) == ("p", "p") and not list(tmp_path.glob(".open-*"))


def test_sink_stays_within_its_folder(spark, tmp_path):
    register(spark)
    inner = tmp_path / "in"
    inner.mkdir()
    for path in ("../x", "/x", "a/../../x", "."):
        with pytest.raises(Exception, match="not within the folder"):
            spark.createDataFrame([(path, b"x")], "path string, content binary").write.format("file_folder").option("path", str(inner)).mode("append").save()
    assert [p.name for p in tmp_path.rglob("*")] == ["in"]
