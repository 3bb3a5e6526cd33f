"""Mixing sources to target weights with DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.store import store

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mixture:
    """exponent of the shares; cutoffs: a row per source (see mixture())."""

    exponent: float
    cutoffs: DataFrame


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """doc_id, source, n_tokens, order_key; the key is a fixed permutation of the documents."""
    key = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens"), key.alias("order_key"))


def fit_exponent(totals: DataFrame, repetition_limit: float | None, target_entropy: float | None, sections: int = 255, digits: int = 9) -> float:
    """Largest exponent in [0, 1] that has at least the target entropy, or the smallest that stays within the limit.

    totals: source, total > 0. With exponent a, weights are total^a / sum; the
    budget is such that the source that is weighted down most is read once, so
    the most repeated one is read (least total / greatest total)^(a - 1) times.
    Entropy (in nats) and repetition both fall as a grows, so the bounds close in
    on the answer: each pass measures `sections` points in one aggregation and
    keeps one of the gaps between them, a row of two numbers.
    """
    top = totals.agg(F.max("total")).first()[0]
    if top is None:
        return 1.0
    share, low, high = totals.select((F.col("total") / F.lit(float(top))).alias("share")), 0.0, 1.0
    w = F.pow("share", F.col("a"))
    while high - low > 10.0 ** -(digits + 2):
        points = F.explode(F.transform(F.sequence(F.lit(1), F.lit(sections)), lambda k: F.lit(low) + F.lit(high - low) * k / F.lit(float(sections + 1)))).alias("a")  # noqa: B023
        sums = share.select("share", points).groupBy("a").agg(F.sum(w).alias("s"), F.sum(w * F.log(w)).alias("l"), F.max(F.pow("share", F.col("a") - 1)).alias("r"))
        # All points below the answer have enough entropy, or too much repetition.
        below = F.log("s") - F.col("l") / F.col("s") >= target_entropy if target_entropy is not None else F.col("r") > repetition_limit
        least, most = sums.agg(F.max(F.when(below, F.col("a"))), F.min(F.when(~below, F.col("a")))).first()
        low, high = (low if least is None else least), (high if most is None else most)
    return round((low + high) / 2, digits)


def running(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of `value` over the rows before each, within keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def mixture(documents: DataFrame, repetition_limit: float | None = None, target_entropy: float | None = None, block_docs: int = 512) -> Mixture:
    """Weights of the sources, and where in each source's permutation its last round ends.

    documents: as sized() gives them. cutoffs: source (null is a source), total,
    target (tokens to read), rounds (whole readings), cutoff (documents with a
    smaller key are read once more). A source is read round by round in blocks of
    its permutation: blocks are key prefixes of about `block_docs` documents, so
    block sums, summed twice (blocks within superblocks), place the cutoff and
    only the block that holds it is sorted. A hot source is never in one task.
    """
    totals = documents.groupBy("source").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n_docs"))
    totals = store(totals, "totals").df
    exponent = fit_exponent(totals.where("total > 0").select("total"), repetition_limit, target_entropy)
    top = float(totals.agg(F.max("total")).first()[0] or 0)
    goal = (
        totals.withColumn("target", F.when(F.col("total") > 0, F.floor(F.col("total") * F.pow(F.col("total") / F.lit(top), F.lit(exponent - 1)))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rounds", F.when(F.col("total") > 0, F.expr("target div total")).otherwise(1))
        .withColumn("rest", F.when(F.col("total") > 0, F.col("target") % F.col("total")).otherwise(0))
        .withColumn("digits", F.greatest(F.lit(0), F.ceil(F.log(F.col("n_docs") / block_docs) / F.log(F.lit(16.0)))).cast("int"))
        .select("source", "total", "target", "rounds", "rest", "digits")
    )
    goal = store(goal, "goal").df
    placed = documents.join(goal, documents.source.eqNullSafe(goal.source)).drop(goal.source).where("rest > 0")
    placed = placed.withColumn("block", F.expr("substring(order_key, 1, digits)"))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"), F.first("digits").alias("digits"))
    blocks = store(blocks.withColumn("upper", F.expr("substring(block, 1, digits div 2)")), "blocks").df
    uppers = running(blocks.groupBy("source", "upper").agg(F.sum("n").alias("m")), ["source"], "upper", "m", "above").drop("m").withColumnRenamed("source", "s").withColumnRenamed("upper", "u")
    lined = running(blocks, ["source", "upper"], "block", "n", "within").join(uppers, F.col("source").eqNullSafe(F.col("s")) & (F.col("upper") == F.col("u")))
    crossing = lined.withColumn("before", F.col("above") + F.col("within")).where("before < rest and before + n >= rest").select(F.col("source").alias("s"), F.col("block").alias("b"), "before", "rest")
    inside = placed.drop("rest").join(crossing, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    inside = inside.groupBy("s", "b", "order_key").agg(F.sum("n_tokens").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inside = running(inside, ["s", "b"], "order_key", "n", "here")
    ends = inside.groupBy("s", "b").agg(F.min(F.when(F.col("before") + F.col("here") >= F.col("rest"), F.col("order_key"))).alias("cutoff"))
    ends = ends.select("s", F.coalesce("cutoff", F.concat("b", F.lit("g"))).alias("cutoff"))
    cutoffs = goal.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "total", "target", "rounds", F.coalesce("cutoff", F.lit("")).alias("cutoff"))
    return Mixture(exponent, store(cutoffs, "cutoffs").df)  # its size is known: the join below is planned by it


def copies() -> Column:
    return (F.col("rounds") + (F.col("order_key") < F.col("cutoff")).cast("long")).cast("long")


def mixed_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", repetition_limit: float | None = 2.0, target_entropy: float | None = None, seed: int = 0) -> DataFrame:
    """doc_id, source, n_tokens, copies: how often each document is in the mixture.

    Every document is in it once at least. Null and empty texts have no tokens:
    a source without tokens has weight 0 and each of its documents one copy.
    Repeated rows share their key and so their copies. An empty table gives an
    empty one; extra columns are ignored.
    """
    measured = store(sized(docs, doc_id, source, text, seed), "sized").df
    cut = mixture(measured, repetition_limit, target_entropy).cutoffs.withColumnRenamed("source", "s")
    return measured.join(cut, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "n_tokens", copies().alias("copies"))


def mix_documents(docs: DataFrame, repetition_limit: float | None = 2.0, target_entropy: float | None = None, seed: int = 0) -> DataFrame:
    """The rows of docs as often as mixed_sources() counts them; texts, of any length, are not shuffled.

    Null and empty texts stay once at least, rows without an id or a source are mixed
    as the others are, rows that share an id as often as each other; an empty table
    gives an empty one. Columns of any name are kept as they are.
    """
    columns = docs.columns
    measured = store(sized(docs, seed=seed), "sized").df
    cut = mixture(measured, repetition_limit, target_entropy).cutoffs.select(F.col("source").alias("_s"), "rounds", "cutoff")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("source").alias("_source"), key.alias("order_key"))
    rows = rows.join(cut, F.col("_source").eqNullSafe(F.col("_s")))
    return rows.select("_row", F.explode(F.sequence(F.lit(1), copies())).alias("_copy")).select("_row.*")
