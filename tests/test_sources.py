"""Files as tables."""

import hashlib
import io
import zipfile

from pyspark.sql import functions as F

from tallyloom.operators import profile as P
from tallyloom.sources import files as S

SALES = [("2024-01-05", "Widget Pro", 1200.5, 3), ("2024-01-09", "Kabelset", None, 2), ("2024-04-18", "Standing Desk", 80.0, 1)]


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


DOCX = package({"word/document.xml": '<w:document xmlns:w="u"><w:body><w:p><w:r><w:t>Titel</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Ein </w:t><w:t>Satz</w:t></w:r></w:p></w:body></w:document>', "word/media/a.png": b"x" * 6000, "word/media/klein.png": b"x"})
PPTX = package({"ppt/slides/slide10.xml": '<a:x xmlns:a="u"><a:p><a:t>zehn</a:t></a:p></a:x>', "ppt/slides/slide2.xml": '<a:x xmlns:a="u"><a:p><a:t>zwei</a:t></a:p></a:x>'})
XLSX = package({"xl/sharedStrings.xml": '<sst xmlns="u"><si><t>Kopf</t></si></sst>', "xl/worksheets/sheet1.xml": '<worksheet xmlns="u"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.5</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>'})
ODT = package({"content.xml": '<o xmlns:text="u"><text:p>Absatz <text:span>eins</text:span></text:p></o>'})


def test_delimited(spark, tmp_path):
    for sep in ",;":
        p = tmp_path / f"s{ord(sep)}.csv"
        p.write_text(sep.join(["datum", "produkt", "umsatz", "menge"]) + "\n" + "\n".join(sep.join("" if v is None else str(v) for v in r) for r in SALES))
        df = S.read_delimited(spark, str(p))
        assert df.columns == ["datum", "produkt", "umsatz", "menge"] and df.count() == 3
        assert P.choose_analyses(df, not P.null_counts(df).isEmpty()) == ["numerisch", "kategorisch", "zeitreihe", "fehlende_werte"]


def test_log(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ok", "x"), ("b", "error", "y"), ("c", "skipped", None), ("d", "skipped", "z")], "source string, status string, target string")
    S.write_log(rows.coalesce(1), str(tmp_path / "log"))
    text = next((tmp_path / "log").glob("part-*")).read_text()
    assert text.startswith("﻿source;status;target\n") and len(text.splitlines()) == 3


def test_pixels(spark):
    wide = spark.createDataFrame([(1, 5, 6, 7)], "label int, p1 int, p10 int, p2 int")
    long = S.pixel_table(wide)
    assert long.first().px == [5.0, 7.0, 6.0]
    assert tuple(S.wide_pixels(long, 3).first()) == (1, 5.0, 7.0, 6.0)


def test_scan(spark, tmp_path):
    (tmp_path / "a/.git").mkdir(parents=True)
    for name, body in {"a/x.TXT": b"hallo", "a/.git/config": b"x", "a/Thumbs.db": b"x", "b.md": b"b", "a/~lock": b"x"}.items():
        (tmp_path / name).write_bytes(body)
    got = {r.path: r for r in S.scan_folder(spark, str(tmp_path)).collect()}
    assert set(got) == {"a/x.TXT", "b.md"} and got["a/x.TXT"].ext == ".txt" and got["a/x.TXT"].sha256 == hashlib.sha256(b"hallo").hexdigest()
    small = {r.path: r.sha256 for r in S.scan_folder(spark, str(tmp_path), hash_limit=2).collect()}
    assert small["a/x.TXT"] is None
    plan = S.scan_folder(spark, str(tmp_path), with_hash=False)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_packages(spark):
    rows = [("d.docx", bytearray(DOCX)), ("p.pptx", bytearray(PPTX)), ("t.xlsx", bytearray(XLSX)), ("o.odt", bytearray(ODT)), ("k.docx", bytearray(b"kaputt")), ("x.pdf", bytearray(ODT)), ("n.docx", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.title, r.excerpt, r.n_images, r.status) for r in S.office_excerpts(files).collect()}
    assert got["d.docx"] == ("Titel", "Titel | Ein Satz", 1, "ok") and got["p.pptx"][1] == "zwei | zehn" and got["o.odt"][0] == "Absatz eins"
    assert got["t.xlsx"][1] == "Kopf |  | 2.5 | x" and got["k.docx"][3] == got["n.docx"][3] == "fehler" and got["x.pdf"][3] == "kein_extraktor"
    cells = [tuple(r) for r in S.read_xlsx(files.where("path = 't.xlsx'")).collect()]
    assert cells == [("t.xlsx", "sheet1", 1, ["Kopf", None, "2.5"]), ("t.xlsx", "sheet1", 3, ["x"])]


def test_data_uri(spark):
    assert spark.range(1).select(S.data_uri(F.lit("hi").cast("binary"), "image/png")).first()[0] == "data:image/png;base64,aGk="


def test_rich_text(spark):
    raw = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\*\generator x;}\pard Titel \b fett\b0\par Gr\'f6\'dfe \u8364?\{5\}\line {\i schr\'e4g}\tab Ende}"
    assert S.rtf_text(raw) == "Titel fett\nGröße €{5}\nschräg\tEnde"
    assert S.rtf_text(rb"{\rtf1\uc2\u-10179??\u-8704??}") == "\U0001f600" and S.rtf_text(rb"{\rtf1 offen{\b x") == "offenx"
    files = spark.createDataFrame([("a.rtf", bytearray(raw)), ("b.rtf", bytearray(b"kaputt"))], "path string, content binary")
    got = {r.path: (r.title, r.status) for r in S.office_excerpts(files).collect()}
    assert got == {"a.rtf": ("Titel fett", "ok"), "b.rtf": ("", "kein_extraktor")}


def test_images(spark, tmp_path):
    import struct

    (tmp_path / "katze").mkdir()
    (tmp_path / "hund").mkdir()
    line = [bytes([1, 2, 3, 4, 5, 6]), bytes([7, 8, 9, 10, 11, 12])]  # two rows of two pixels, red first
    bgr = [b"".join(r[k : k + 3][::-1] for k in (0, 3)) + b"\0\0" for r in line]
    (tmp_path / "katze/a.BMP").write_bytes(b"BM" + struct.pack("<IHHI", 54 + 16, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + bgr[1] + bgr[0])
    (tmp_path / "hund/b.ppm").write_bytes(b"P6\n# Bild\n2 2\n255\n" + b"".join(line))
    (tmp_path / "hund/c.pgm").write_bytes(b"P5 3 1 255\n" + bytes([9, 8, 7]))
    (tmp_path / "hund/d.pgm").write_bytes(b"P5 3 9 255\nzu kurz")
    (tmp_path / "hund/e.txt").write_bytes(b"kein Bild")
    got = {r.path.rsplit("/", 1)[1]: r for r in S.image_folder(spark, str(tmp_path)).collect()}
    for name, label in (("a.BMP", "katze"), ("b.ppm", "hund")):
        r = got[name]
        assert (r.label, r.n_rows, r.n_columns, r.samples, bytes(r.pixels), r.error) == (label, 2, 2, 3, b"".join(line), None)
    assert (got["c.pgm"].n_columns, bytes(got["c.pgm"].pixels)) == (3, bytes([9, 8, 7])) and got["d.pgm"].error and set(got) == {"a.BMP", "b.ppm", "c.pgm", "d.pgm"}


def test_delimited_round_trip(spark, tmp_path):
    wide = S.wide_pixels(spark.createDataFrame([(1, [5.0, 6.5]), (2, [7.0, None])], "label int, px array<double>"), 2)
    for sep in ",;":
        S.write_delimited(wide, str(tmp_path / "w"), sep)
        assert sorted(map(tuple, S.read_delimited(spark, str(tmp_path / "w")).collect())) == [(1, 5.0, 6.5), (2, 7.0, None)]


def test_chunk_and_vector_store(spark, tmp_path):
    from tallyloom.operators import retrieval as R

    docs = spark.createDataFrame([(1, "eins zwei " * 90), (2, "drei"), (3, None)], "doc_id long, text string")
    path = f"file://{tmp_path}/chunks"
    R.write_chunks(R.chunk_fixed(docs.where("doc_id = 2")), path)
    chunks = R.write_chunks(R.chunk_fixed(docs), path)  # in place of the older ones
    assert chunks.count() == R.chunk_fixed(docs).count() == 4
    index = R.write_vectors(R.embed(chunks, lambda texts: [[len(t), t.count("e"), 0] for t in texts], batch=2), f"file://{tmp_path}/vectors")
    for r in index.collect():
        assert r.embedding[0] == len(r.chunk) + len("passage: ") and abs(r.norm - sum(x * x for x in r.embedding) ** 0.5) < 1e-4
    best = R.top(R.cosine(index, [1.0, 0.0, 0.0]), "score", "doc_id", 1).first()
    assert best.doc_id == 2
    scores = docs.select("doc_id", R.overlap_score(F.col("text"), "zwei drei", 1).alias("s")).collect()
    assert {r.doc_id: r.s for r in scores} == {1: 0.0, 2: 0.5, 3: 0.0}


def test_scratch_tables_are_dropped(spark):
    import os

    from tallyloom import store as T

    place = lambda made: made.path.removeprefix("file://")
    with T.scratch():
        a = T.store(spark.range(5).toDF("k"), "a")
        with T.scratch():
            b, c = T.store(a.df, "b"), T.keep(T.store(a.df, "c"))
            bucketed = T.store_bucketed(a.df, "d", "k", 3)
            tables = {t.name for t in spark.catalog.listTables()}
            assert bucketed.count() == 5
        assert not os.path.exists(place(b)) and c.df.count() == 5
        assert len(tables) == 1 + len({t.name for t in spark.catalog.listTables()})
    assert not os.path.exists(place(a)) and not os.path.exists(place(c))
