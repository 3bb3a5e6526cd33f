"""Page extraction and paragraph styles as bounded workflows over tables: all open parts go through a step together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import layout as L
from tallyloom.operators.documents import style_changes
from tallyloom.operators.workflow import END, Workflow

BATCH = 40  # paragraphs that a model is asked about at a time


def page_parts(pictures: DataFrame, texts: DataFrame, lines: DataFrame) -> DataFrame:
    """The parts of each page in reading order, as manifest() reads them, with page, place and text; noise is marked as dropped."""
    free = L.free_text(texts, pictures)
    captions = L.captions(pictures, lines).select("block_id", "caption")
    kind = F.when(F.col("hint") == "bild", L.picture_kind(F.col("caption"))).otherwise(F.col("hint"))
    ordered = L.reading_order(pictures.unionByName(free)).join(captions, "block_id", "left")
    file = F.concat("block_id", F.when(F.col("hint") == "text", ".txt").otherwise(".png"))
    none = F.lit(None)
    return ordered.select("page", "place", "block_id", kind.alias("typ"), file.alias("quelldateireferenz"), "caption", "text", none.cast("string").alias("beschreibung"), none.cast("boolean").alias("akzeptiert"), L.is_noise().alias("verworfen"))


def extraction_flow(describe: Callable[[int], Column], accept: Callable[[int], Column], most_tries: int = 3) -> Workflow:
    """From state pictures, texts, lines to state parts and entries (the manifest).

    describe and accept give, for the number of the try, the description of a picture
    or table and whether it will do. What isn't accepted is described again,
    `most_tries` times at most, and then goes into the manifest as poor.
    """
    waits = F.col("typ").isin("bild", "diagramm", "tabelle") & ~F.col("verworfen") & ~F.coalesce("akzeptiert", F.lit(False))
    where = lambda name, value: lambda s: {"parts": s["parts"].withColumn(name, F.when(waits, value(s["tries"])).otherwise(F.col(name)))}
    nodes = {
        "split": lambda s: {"parts": page_parts(s["pictures"], s["texts"], s["lines"]), "tries": 0},
        "describe": where("beschreibung", describe),
        "check": lambda s: where("akzeptiert", accept)(s) | {"tries": s["tries"] + 1},
        "write": lambda s: {"entries": L.manifest(s["parts"])},
    }
    again = lambda s: "describe" if s["tries"] < most_tries and not s["parts"].where(waits).isEmpty() else "write"
    return Workflow("split", nodes, {"split": again, "describe": "check", "check": again, "write": END}, most_steps=2 * most_tries + 5)


def style_flow(propose: Callable[[DataFrame], DataFrame]) -> Workflow:
    """From state paragraphs (doc_id, index, style, text) to state changes and paragraphs with the styles proposed.

    propose gets the paragraphs with their batch of BATCH and gives doc_id, index, style;
    styles of paragraphs that don't exist are among the changes, but change nothing.
    """

    def apply(s: dict) -> dict:
        new = s["proposed"].select("doc_id", "index", F.col("style").alias("_new"))
        return {"paragraphs": s["paragraphs"].join(new, ["doc_id", "index"], "left").withColumn("style", F.coalesce("_new", "style")).drop("_new")}

    nodes = {
        "ask": lambda s: {"proposed": propose(s["paragraphs"].withColumn("batch", F.floor(F.col("index") / BATCH)))},
        "compare": lambda s: {"changes": style_changes(s["paragraphs"].select("doc_id", "index", "style"), s["proposed"])},
        "apply": apply,
    }
    return Workflow("ask", nodes, {"ask": "compare", "compare": "apply", "apply": END})
