"""Splits that keep related records together: linked groups and their stratified placement."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm.components import connected_components
from spanforge.session import Scratch


def node(kind: int, value: Column) -> Column:
    """A value as a node of the graph: a byte for its kind, then its bytes. Kinds come first in the order."""
    return F.concat(F.unhex(F.lit(f"{kind:02x}")), value.cast("binary"))


def group_nodes(spark: SparkSession, records: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """(node, component) of every value in the columns ``nodes`` that records link to another value.

    The graph is one of values, not of records: a value that a third of the records share is one
    node, with an edge for each different value beside it. Nulls link nothing.
    """
    links = None
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            part = records.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
            links = part if links is None else links.unionByName(part)
    return connected_components(spark, links)


def with_groups(spark: SparkSession, records: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """``records`` with the binary ``group`` that all records sharing a node have in common.

    The group is the least node of the component; it is null for a record without any node,
    which is a group by itself.
    """
    components = group_nodes(spark, records, nodes).select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    keyed = records.withColumn("__first", F.coalesce(*[F.col(c) for c in nodes]))
    return keyed.join(components, keyed["__first"] == components["__node"], "left").withColumn("group", F.coalesce("__component", "__first")).drop("__first", "__node", "__component")


def spanning_groups(spark: SparkSession, records: DataFrame, nodes: Sequence[str], split: str) -> DataFrame:
    """The records, with their ``group``, of groups that show two or more different values of ``split``; nulls don't count."""
    components = group_nodes(spark, records, nodes).select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    first = F.coalesce(*[F.col(c) for c in nodes])
    # Few rows per node, however many records share it.
    shown = records.select(first.alias("__first"), F.col(split).alias("__split")).where("__first is not null and __split is not null").distinct()
    shown = shown.join(components, shown["__first"] == components["__node"], "left").select(F.coalesce("__component", "__first").alias("group"), "__split")
    mixed = shown.groupBy("group").agg(F.countDistinct("__split").alias("__n")).where("__n >= 2").select("group")
    # All nodes of these groups: those of the components, and single nodes that are a group themselves.
    of_component = components.join(mixed, components["__component"] == mixed["group"]).select("__node", "group")
    own = mixed.select(F.col("group").alias("__node"), "group")
    members = of_component.unionByName(own).distinct()
    keyed = records.withColumn("__first", first)
    return keyed.join(members, keyed["__first"] == members["__node"]).drop("__first", "__node")


def dealt(want: np.ndarray, room: np.ndarray, size: float, copies: int) -> np.ndarray:
    """How many of ``copies`` equal items of ``size`` each split gets, one after another to the one that wants most (ties: most room, then the first)."""
    want, out = want.astype(float).copy(), np.zeros(len(want), np.int64)
    while copies:
        order = np.lexsort((np.arange(len(want)), -room, -want))
        top = [s for s in order if want[s] > want[order[0]] - max(size, 1e-9)]
        if copies < len(top) or size <= 0:
            one = order[0]
            out[one] += 1 if size > 0 else copies
            want[one] -= size
            copies -= 1 if size > 0 else copies
            continue
        rounds = copies // len(top)
        if len(top) < len(order):
            rounds = min(rounds, max(1, int((want[top].min() - want[order[len(top)]]) // size)))
        out[top] += rounds
        want[top] -= rounds * size
        copies -= rounds * len(top)
    return out


class Placement:
    """Iterative stratification over classes of equal items, each with a vector of label counts.

    The label with the fewest outstanding records comes first; its largest items go to the split
    that still needs most of that label (ties: most records, then the split named first).
    """

    def __init__(self, totals: np.ndarray, shares: np.ndarray):
        self.need = np.outer(shares, totals).astype(float)  # split x label; the first label is the number of records

    def run(self, vectors: np.ndarray, copies: np.ndarray) -> np.ndarray:
        """Items of each class (row) per split (column)."""
        placed, open_ = np.zeros((len(vectors), len(self.need)), np.int64), np.ones(len(vectors), bool)
        left = (vectors * copies[:, None]).sum(0)
        while open_.any():
            labels = np.flatnonzero(left[1:] > 0) + 1
            label = labels[np.argmin(left[labels])] if len(labels) else 0
            mine = np.flatnonzero(open_ & ((vectors[:, label] > 0) | (label == 0)))
            for item in mine[np.lexsort((mine, -vectors[mine, 0], -vectors[mine, label]))]:
                placed[item] = dealt(self.need[:, label], self.need[:, 0], vectors[item, label], int(copies[item]))
                self.need -= placed[item][:, None] * vectors[item]
            open_[mine] = False
            left = (vectors[open_] * copies[open_][:, None]).sum(0)
        return placed


def grouped_split(
    spark: SparkSession,
    records: DataFrame,
    record_id: str,
    group: str,
    label_columns: dict[str, Column],
    shares: dict[str, float],
    per_task: int = 10_000,
) -> DataFrame:
    """(record_id, split) such that all records of a ``group`` get the same split.

    Grouped iterative stratification. The label vector of a group counts its records, and those
    for which each of ``label_columns`` (boolean) holds. Groups with equal vectors can stand for each other, so the driver
    places classes of them: it sees each different vector once, with its number of groups, and deals every group. Which groups of a
    class a split gets is decided by their rank in hash order, counted over hash ranges of about ``per_task`` groups.
    The rule is the same at every size.

    A record with a null group is a group by itself; repeated rows count once (of one id with several groups the least); a null id is a
    record, too; other columns aren't read; an empty table gives an empty result. Equal counts
    are placed in the order of the vectors, so that the result doesn't change with the
    order of rows.
    """
    scratch = Scratch(spark, "split")
    hashed = F.coalesce(F.col(group), F.concat(F.lit("record:"), F.coalesce(F.col(record_id).cast("string"), F.lit(""))).cast("binary"))
    labels = [f"l{i}" for i in range(len(label_columns))]
    rows = records.select(F.col(record_id).alias("id"), hashed.alias("g"), *[F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in zip(labels, label_columns.values(), strict=True)])
    # One row per id, however its repeated rows differ.
    rows = scratch.write(rows.groupBy("id").agg(F.min("g").alias("g"), *[F.max(c).alias(c) for c in labels]), "records")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in labels])
    groups = scratch.write(groups.select("g", F.concat_ws(",", "n", *labels).alias("vector")), "groups")
    classes = sorted(((tuple(map(int, r["vector"].split(","))), r["count"]) for r in groups.groupBy("vector").count().collect()), reverse=True)
    splits = list(shares)
    plan = []
    if classes:
        weights = np.array([shares[s] for s in splits], float)
        vectors, copies = np.array([v for v, _ in classes], float), np.array([k for _, k in classes], np.int64)
        placed = Placement((vectors * copies[:, None]).sum(0), weights / weights.sum()).run(vectors, copies)
        plan = [(",".join(map(str, v)), int(k), [int(x) for x in np.cumsum(p)]) for (v, k), p in zip(classes, placed, strict=True)]
    plan = spark.createDataFrame(plan, "vector string, k bigint, cuts array<bigint>")
    dealt_groups = groups.join(plan, "vector").withColumn("part", F.pmod(F.xxhash64("g"), F.ceil(F.col("k") / per_task)))
    sizes = dealt_groups.groupBy("vector", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("vector").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("vector", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("vector", "part").orderBy(F.xxhash64("g", F.lit(1)), "g"))
    ranked = dealt_groups.withColumn("place", place).join(sizes, ["vector", "part"]).withColumn("rank", F.col("place") + F.col("before"))
    cut = F.size(F.filter("cuts", lambda c: c < F.col("rank")))
    placed_groups = ranked.select("g", F.element_at(F.array(*[F.lit(s) for s in splits]), cut + 1).alias("split"))
    return rows.select("id", "g").join(placed_groups, "g").select(F.col("id").alias(record_id), "split")
