import json

from pyspark.sql import functions as F

from tallyloom.operators import documents as D
from tallyloom.operators import inventory as I


def excerpts(spark, texts, extract):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    return [(r.e.title, r.e.excerpt) for r in rows.select("k", extract(F.col("text")).alias("e")).orderBy("k").collect()]


def test_mail_headers(spark):
    texts = [
        "From: a@x\nSUBJECT: Eins\n  und zwei\nTo: b\n\nSubject: nicht dieser",
        "subject:ohne Absender\r\nX: y\r\n\r\nFrom: z",
        "\nFrom: im Text\nSubject: im Text",
        "Subject: eins\nSubject: zwei\nReply-From: nein\nFrom: ja",
        "Subject: " + "x" * 400,
        "",
        None,
    ]
    got = excerpts(spark, texts, D.mail_excerpt)
    assert got[0] == ("Eins und zwei", "Von: a@x | Betreff: Eins und zwei")
    assert got[1] == ("ohne Absender", "Von:  | Betreff: ohne Absender")
    assert got[2] == got[5] == got[6] == ("", "Von:  | Betreff: ")
    assert got[3] == ("eins", "Von: ja | Betreff: eins")
    assert got[4] == ("x" * 120, ("Von:  | Betreff: " + "x" * 400)[:300])


def test_notebooks(spark):
    cell = lambda kind, source: {"cell_type": kind, "source": source}
    full = {"cells": [cell("code", "import a\nx = 1\n  from b import c"), cell("markdown", ["Text\n", "## Kopf #1 \n", "mehr"]), cell("raw", "# nein"), *[cell("markdown", f" {k} " + "y" * 300) for k in range(3)], cell("code", [f"import m{k}\n" for k in range(9)])]}
    got = excerpts(spark, [json.dumps(full), '{"cells": [{"cell_type": "markdown"}]}', '{"cells": []}', "{}", "kaputt {", "", None], D.notebook_excerpt)
    whole = "Text\n## Kopf #1 \nmehr | " + ("0 " + "y" * 300)[:200] + " | " + ("1 " + "y" * 300)[:200]
    assert got[0] == ("Kopf #1", whole[:300])
    assert got[1:] == [("", "")] * 6
    short = {"cells": [cell("markdown", "# T"), cell("code", [f"import m{k}\n" for k in range(9)])]}
    assert excerpts(spark, [json.dumps(short)], D.notebook_excerpt) == [("T", "# T | Imports: import m0, import m1, import m2, import m3, import m4")]


def test_undo_of_a_long_batch(spark):
    log = spark.range(5_000).selectExpr("int(id % 2) AS batch", "id div 7 AS step", "'s' || id % 11 AS source", "'t' || id AS target").repartition(5)
    got = sorted(I.undo_plan(log).collect())
    rows = sorted(((-(k // 7), f"s{k % 11}", f"t{k}") for k in range(5_000) if k % 2))
    assert [tuple(r) for r in got] == [(n, t, s) for n, (_, s, t) in enumerate(rows, 1)]
    assert I.undo_plan(log.limit(0)).count() == 0
