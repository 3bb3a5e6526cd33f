"""The extraction and style workflows on small tables."""

import json

from pyspark.sql import functions as F

from tallyloom.operators import agents as A

BLOCK = "page long, block_id string, hint string, x0 double, y0 double, x1 double, y1 double, text string"


def test_extraction(spark):
    pictures = spark.createDataFrame([(1, "logo", "bild", 520.0, 20.0, 560.0, 60.0, ""), (1, "tab", "tabelle", 50.0, 150.0, 290.0, 210.0, ""), (1, "pic", "bild", 50.0, 320.0, 250.0, 440.0, ""), (2, "two", "bild", 50.0, 320.0, 250.0, 440.0, "")], BLOCK)
    texts = spark.createDataFrame([(1, "in", "text", 60.0, 160.0, 200.0, 200.0, "in der Tabelle"), (1, "top", "text", 50.0, 60.0, 500.0, 100.0, "frei")], BLOCK)
    lines = spark.createDataFrame([(1, 1, 50.0, 445.0, 250.0, 457.0, "Abbildung 1")], "page long, line_no long, x0 double, y0 double, x1 double, y1 double, text string")
    flow = A.extraction_flow(lambda k: F.concat("block_id", F.lit(f" {k}")), lambda k: (F.col("block_id") == "tab") | (F.col("block_id") == "pic") & F.lit(k >= 1))
    steps = [(n, s) for n, _, s in flow.stream({"pictures": pictures, "texts": texts, "lines": lines})]
    assert [n for n, _ in steps] == ["split", *["describe", "check"] * 3, "write"]
    state = steps[-1][1]
    got = {r.block_id: json.loads(r.entry) for r in state["entries"].collect()}
    assert set(got) == {"tab", "pic", "two", "top"} and got["pic"]["typ"] == "diagramm" and got["pic"]["caption"] == "Abbildung 1" and got["top"]["typ"] == "text"
    assert (got["tab"]["beschreibung"], got["pic"]["beschreibung"], got["two"]["beschreibung"]) == ("tab 0", "pic 1", "two 2")
    assert got["two"]["qualitaet"] == "niedrig" and "qualitaet" not in got["pic"]
    order = [r.block_id for r in state["parts"].where("page = 1 and not verworfen").orderBy("place").collect()]
    assert order == ["top", "tab", "pic"]
    nothing = flow.run({"pictures": pictures.where("block_id = 'logo'"), "texts": texts.limit(0), "lines": lines})
    assert nothing["entries"].count() == 0 and nothing["tries"] == 0


def test_styles(spark):
    rows = spark.createDataFrame([(1, k, "Normal", f"t{k}") for k in range(90)], "doc_id long, index long, style string, text string")
    seen = []

    def propose(p):
        seen.append(p.groupBy("batch").count().count())
        return p.where("index % 30 = 0").select("doc_id", "index", F.lit("Titel").alias("style")).unionByName(p.limit(1).select("doc_id", F.lit(999).cast("long").alias("index"), F.lit("Text").alias("style")))

    out = A.style_flow(propose).run({"paragraphs": rows})
    assert seen == [3] and {(r["index"], r.old_style) for r in out["changes"].collect()} == {(0, "Normal"), (30, "Normal"), (60, "Normal"), (999, "?")}
    assert {r["index"] for r in out["paragraphs"].where("style = 'Titel'").collect()} == {0, 30, 60} and out["paragraphs"].count() == 90
