"""Consolidating pairwise matches into groups by alternating star rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.session import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every edge u > v becomes (u, m), m the least of v and all its neighbours. Repeated edges may come out; no more rows than went in."""
    both = edges.select("v", F.least("u", "v").alias("x")).unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("x")))
    least = both.groupBy("v").agg(F.min("x").alias("m"))
    return edges.join(least, "v").select("u", F.col("m").alias("v"), (F.col("m") != F.col("v")).alias("changed"))


def _small_star(edges: DataFrame) -> DataFrame:
    """The lesser neighbours of u, and u itself, are tied to the least of them; ``changed`` marks edges that weren't there before."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.bool_or("changed").alias("changed"))
    moved = edges.join(least.select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("changed"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"), "changed")).groupBy("u", "v").agg(F.bool_or("changed").alias("changed"))


def _settled(edges: DataFrame) -> DataFrame:
    """The roots of finished stars: nodes that are greater than none, all of whose neighbours have no other neighbour."""
    degree = edges.select("u").unionByName(edges.select(F.col("v").alias("u"))).groupBy("u").agg(F.count("*").alias("d"))
    ends = edges.join(degree, "u").groupBy("v").agg(F.max("d").alias("most")).where("most = 1").select("v")
    return ends.join(edges.select(F.col("u").alias("v")), "v", "left_anti")


def connected_components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that an edge links to another; the component is its least node.

    Large-star and small-star rewrites alternate, as joins, until a round changes no edge. A
    round keeps one pair (node, minimum) per edge at most; minima are combined before they are
    shuffled, so that a hub costs no more than its edges, which the skew join splits. Finished
    stars leave the working set before the first round and after each one, so later rounds see
    unfinished components only.

    Edges with a null end and edges from a node to itself are no links; repeated edges, and the
    same edge the other way round, count once; an empty table gives an empty result. Other
    columns aren't read. The ends may be of any type that can be ordered.
    """
    scratch = Scratch(spark, "components")
    clean = edges.where(F.col(f"`{a}`") != F.col(f"`{b}`")).select(F.greatest(f"`{a}`", f"`{b}`").alias("u"), F.least(f"`{a}`", f"`{b}`").alias("v"))
    now = scratch.write(clean.distinct(), "edges")
    stars = None
    while True:
        roots = scratch.write(_settled(now), "roots")
        done = now.join(roots, "v", "left_semi").select("u", "v")
        stars = done if stars is None else stars.unionByName(done)
        after = scratch.write(_small_star(_large_star(now.join(roots, "v", "left_anti"))), "stars")
        now = after.select("u", "v")
        if after.where("changed").isEmpty():
            stars = stars.unionByName(now)
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
