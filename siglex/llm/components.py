"""Connected components of link tables that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siglex.llm.scratch import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round of large-star or small-star over edges (u, v) with u > v."""
    if large:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = sides.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _edges(links: DataFrame) -> DataFrame:
    return links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is below one other at most and no node is both above and below: then no round changes anything."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("above")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("above")))
    nodes = ends.groupBy("node").agg(F.min("above").alias("x"), F.max("above").alias("y"), F.bool_or(F.col("above").isNull()).alias("centre"))
    return not nodes.where("x < y or centre and x is not null").agg(F.count("*")).first()[0]


def _round(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star, of a written table; each star reads its input four times, so what is between them is written too."""
    return _stars(written(_stars(edges, large=True), "stars"), large=False)


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) with the components of ``links`` after one round of large-star and small-star, a > b.

    Their least b for each a is a label: equal labels are of one component,
    while unequal ones may be too until the rounds have ended. ``links`` are
    read several times, so they should be a written table.
    """
    return _round(_edges(links)).select(F.col("u").alias("a"), F.col("v").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); the component is its least node.

    Alternating large-star and small-star rounds; each round's edges are written
    to the shared folder, and only the number of nodes that are not yet in a star
    reaches the driver. Links of a node with itself or with null are ignored; no
    links, no rows.
    """
    edges = written(_edges(links).distinct(), "links")
    while not _are_stars(edges):
        edges = written(_round(edges), "links")
    return edges.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
