"""Page layout: overlaps, captions, noise, reading order, the manifest.

Blocks are rows page, block_id, hint, x0, y0, x1, y1, text. Pages hold few blocks,
so pairs are formed within a page: an equality join with a condition, never a
product over pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Caption words that mark a chart.
CHART_WORDS = "diagramm|abbildung|chart|grafik|schaubild"
PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0


def box(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def covered_share(a: list[Column], b: list[Column]) -> Column:
    """Share of a's own area that lies in b."""
    width, height = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = F.greatest(a[2] - a[0], F.lit(1e-6)) * F.greatest(a[3] - a[1], F.lit(1e-6))
    return F.when((width > 0) & (height > 0), width * height / area).otherwise(0.0)


def free_text(texts: DataFrame, pictures: DataFrame, most: float = 0.5) -> DataFrame:
    """Text blocks of which no picture or table on the page covers more than `most`."""
    p = pictures.select(F.col("page").alias("p_page"), *[F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    return texts.join(p, (F.col("page") == F.col("p_page")) & (covered_share(box(), box("p_")) > most), "left_anti")


def captions(pictures: DataFrame, lines: DataFrame, reach: float = 40.0, least_overlap: float = 0.3) -> DataFrame:
    """page, block_id, caption: the nearest line below that overlaps enough; the later line on a tie; empty without one.

    lines: page, line_no, x0, y0, x1, y1, text.
    """
    t = lines.select(F.col("page").alias("t_page"), "line_no", F.col("text").alias("t_text"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    overlap = F.greatest(F.lit(0.0), F.least(F.col("x1"), F.col("t_x1")) - F.greatest(F.col("x0"), F.col("t_x0")))
    gap = F.col("t_y0") - F.col("y1")
    near = (F.col("page") == F.col("t_page")) & (overlap / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-6)) >= least_overlap) & gap.between(0, reach)
    best = F.min(F.when(F.col("line_no").isNotNull(), F.struct(gap.alias("gap"), (-F.col("line_no")).alias("later"), F.substring("t_text", 1, 150).alias("text"))))
    return pictures.join(t, near, "left").groupBy("page", "block_id").agg(best.alias("b")).select("page", "block_id", F.coalesce("b.text", F.lit("")).alias("caption"))


def is_noise(width: float = PAGE_WIDTH, height: float = PAGE_HEIGHT) -> Column:
    """A picture of less than a twentieth of the page in one of its corners."""
    x0, y0, x1, y1 = box()
    area = F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))
    corner = ((x0 < width * 0.2) | (x1 > width * 0.8)) & ((y0 < height * 0.2) | (y1 > height * 0.8))
    return (F.col("hint") == "bild") & (area / max(width * height, 1.0) < 0.05) & corner


def picture_kind(caption: Column) -> Column:
    return F.when(F.lower(caption).rlike(CHART_WORDS), "diagramm").otherwise("bild")


def reading_order(blocks: DataFrame) -> DataFrame:
    """blocks with `place` from 1, by rounded top, then left edge."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(F.bround("y0", 1), F.bround("x0", 1), "block_id")).cast("long"))


def manifest(parts: DataFrame) -> DataFrame:
    """JSON entry of each part that was not dropped; fields depend on the kind.

    parts: block_id, typ, quelldateireferenz, caption, beschreibung, akzeptiert, verworfen.
    """
    described = F.col("typ").isin("bild", "diagramm", "tabelle")
    text = F.when(described, F.coalesce("beschreibung", F.lit(""))).alias("beschreibung")
    poor = F.when(described & (F.col("akzeptiert") == F.lit(False)), "niedrig").alias("qualitaet")
    entry = F.struct(F.coalesce("typ", F.lit("")).alias("typ"), F.coalesce("quelldateireferenz", F.lit("")).alias("quelldateireferenz"), F.coalesce("caption", F.lit("")).alias("caption"), text, poor)
    return parts.where(~F.coalesce("verworfen", F.lit(False))).select("block_id", F.to_json(entry).alias("entry"))
