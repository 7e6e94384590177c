"""Connected components by alternating large-star and small-star steps on written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotframe.llm.common import join_counted, stored

STEPS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (node, root): the smallest node that each node reaches. Nodes without edges are not
    in it; nulls and loops are left out. Hubs are spread, nothing is collected."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = stored(links, "links")
    before = None
    for _ in range(STEPS):
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if not state["n"] or state == before:
            break
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = star(both, 2 * state["n"], large=True).distinct()
        links = stored(star(links, None, large=False).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further ``links`` (a, b): only edges between roots are looked at, so this
    costs as much as the links that tie components together, and not what the components hold."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    edges = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    edges = edges.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = stored(components(edges).select(F.col("node").alias("root"), F.col("root").alias("top")), "tops")
    moved = roots.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = tops.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti")
    return stored(moved.unionByName(fresh), "roots")


def star(links: DataFrame, total: int | None, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours are tied to the smallest of it and its neighbours. Small star: each
    node and its smaller neighbours are tied to the smallest of them (``links`` hold u > v)."""
    links = links if total is not None else stored(links, "star")
    total = total if total is not None else links.count()
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if large:
        least = least.withColumn("m", F.least("u", "m"))
        rows = join_counted(links, least, "u", "n", total, F.col("v")).where("v > u")
        return rows.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    rows = join_counted(links, least, "u", "n", total, F.col("v"))
    return rows.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        least.select("u", F.col("m").alias("v")))
