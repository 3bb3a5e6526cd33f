"""Strongly connected components, of many graphs at once, by colours forward and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.store import store

SORTED = "merge"  # a stored table of few distinct values is far smaller than its rows: by its size alone, Spark would send it whole through the driver


def _spread(edges: DataFrame, start: DataFrame, by: list[str]) -> DataFrame:
    """by, node, colour: the greatest colour that reaches each node along edges by, u, v; start: by, node, colour of every node."""
    held = store(start, "colours")
    while True:
        sent = held.df.select(*by, F.col("node").alias("u"), "colour").join(edges.hint(SORTED), [*by, "u"]).groupBy(*by, F.col("v").alias("node")).agg(F.max("colour").alias("sent"))
        now = held.df.join(sent.hint(SORTED), [*by, "node"], "left").select(*by, "node", F.greatest("colour", F.coalesce("sent", "colour")).alias("colour"), (F.col("sent") > F.col("colour")).alias("changed"))
        after = store(now, "colours")
        held.drop()
        held = after
        if held.df.where("changed").isEmpty():
            return held.df.select(*by, "node", "colour")


def strong_components(edges: DataFrame, *keys: str) -> DataFrame:
    """keys, node, component (its smallest node) of the components with more than one node, or with an edge to itself.

    edges: keys, source, target. In turns: nodes that nothing enters or leaves are taken
    away; each node gets the greatest node that reaches it as its colour; those
    that reach the node of their colour within the colour are its component, and go.
    Each turn ends at least the component of the greatest node of every graph, and of
    every colour; a step of a turn is a join and an aggregate, for all graphs at once.
    """
    by = list(keys)
    left = store(edges.select(*by, F.col("source").alias("u"), F.col("target").alias("v")).where("u is not null and v is not null").distinct(), "edges")
    loops = left.df.where("u = v").select(*by, F.col("u").alias("node"))
    parts = [loops.select(*by, "node", F.col("node").alias("root"), F.lit(1).alias("loop"))]
    n, rest = left.df.count(), left.df
    while n:
        while True:  # peel
            enters, leaves = rest.select(*by, F.col("v").alias("u")).distinct(), rest.select(*by, F.col("u").alias("v")).distinct()
            rest = store(rest.where("u <> v").join(enters.hint(SORTED), [*by, "u"], "left_semi").join(leaves.hint(SORTED), [*by, "v"], "left_semi").select(*by, "u", "v"), "edges").df
            before, n = n, rest.count()
            if n in (0, before):
                break
        if not n:
            break
        nodes = rest.select(*by, F.col("u").alias("node")).distinct()
        colours = store(_spread(rest, nodes.withColumn("colour", F.col("node")), by), "coloured").df
        of = lambda c: colours.select(*by, F.col("node").alias(c), F.col("colour").alias(f"_{c}")).hint(SORTED)
        within = store(rest.join(of("u"), [*by, "u"]).join(of("v"), [*by, "v"]).where("_u = _v").select(*by, "u", "v"), "within").df
        back = within.select(*by, F.col("v").alias("u"), F.col("u").alias("v"))
        first = colours.select(*by, "node", F.when(F.col("node") == F.col("colour"), 1).otherwise(0).alias("reached"), "colour")
        reached = _spread(back, first.select(*by, "node", F.col("reached").alias("colour")), by).where("colour = 1").select(*by, "node")
        found = store(colours.join(reached.hint(SORTED), [*by, "node"]).select(*by, "node", F.col("colour").alias("root")), "found").df
        parts.append(found.withColumn("loop", F.lit(0)))
        gone = found.select(*by, F.col("node").alias("u"))
        rest = store(within.join(gone.hint(SORTED), [*by, "u"], "left_anti").join(gone.withColumnRenamed("u", "v").hint(SORTED), [*by, "v"], "left_anti").select(*by, "u", "v"), "edges").df
        n = rest.count()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    one = store(every.groupBy(*by, "node").agg(F.max("root").alias("root"), F.max("loop").alias("loop")), "roots").df  # a node with a loop may stand in a larger component
    whole = one.groupBy(*by, "root").agg(F.min("node").alias("component"), F.count("*").alias("size"))
    return one.join(whole.hint(SORTED), [*by, "root"]).where("size > 1 or loop = 1").select(*by, "node", "component")
