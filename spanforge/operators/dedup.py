"""Exact and near duplicates: collapse, cross-split groups, banded Hamming joins, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.session import Scratch


def first_of_group(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each ``key`` with the number of rows that fell together; a null key is a group of its own row.

    Only the order columns and the least of them are compared, by a combining aggregate, so that a
    key shared by very many rows needs no sort in one task.
    """
    ranked = df.withColumn("_o", F.struct(*order)).withColumn("_k", F.col(key))
    rows = ranked.where("_k is not null").groupBy("_k").agg(F.min_by(F.struct(*[F.col(c) for c in df.columns]), "_o").alias("r"), F.count("*").alias("n_rows"))
    single = ranked.where("_k is null").select(*df.columns, F.lit(1).cast("bigint").alias("n_rows"))
    return rows.select("r.*", "n_rows").unionByName(single)


def band(hash_: Column, widths: Sequence[int]) -> Column:
    """Array of (band number, bits of the band), low bits first."""
    parts, at = [], 0
    for i, bits in enumerate(widths):
        parts.append(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(hash_, at).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1)).alias("bits")))
        at += bits
    return F.array(*parts)


def widths(bits: int, bands: int) -> list[int]:
    """Widths of ``bands`` bands, the wider ones first."""
    short, more = divmod(bits, bands)
    return [short + (i < more) for i in range(bands)]


def hamming_join(left: DataFrame, right: DataFrame, distance: int, bits: int = 64, hash_: str = "hash") -> DataFrame:
    """Pairs with hashes at ``distance`` bits at most, with column ``hamming``.

    Hashes are cut into ``distance`` + 1 bands: two that differ in ``distance`` bits agree in one band.
    Columns of the sides must have different names, but for the hash. A pair is kept at its
    first common band only, so no duplicates have to be removed.
    """
    cut = widths(bits, distance + 1)
    l = left.withColumn("_l", band(F.col(hash_), cut)).withColumnRenamed(hash_, "_hl").withColumn("_b", F.explode("_l"))
    r = right.withColumn("_r", band(F.col(hash_), cut)).withColumnRenamed(hash_, "_hr").withColumn("_c", F.explode("_r"))
    joined = l.join(r, (F.col("_b.band") == F.col("_c.band")) & (F.col("_b.bits") == F.col("_c.bits")))
    first = F.array_position(F.zip_with("_l", "_r", lambda a, b: a["bits"] == b["bits"]), True) - 1
    near = F.bit_count(F.col("_hl").bitwiseXOR(F.col("_hr")))
    return joined.where((near <= distance) & (first == F.col("_b.band"))).withColumn("hamming", near.cast("int")).drop("_l", "_r", "_hl", "_hr", "_b", "_c")


def cosine(a: str, b: str) -> Column:
    """Dot product of two unit vectors in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def components(spark: SparkSession, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that each node is linked to, by passing minima on until nothing changes."""
    scratch = Scratch(spark, "groups")
    pairs = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = scratch.write(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    label = scratch.write(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component")), "labels")
    while True:
        seen = both.join(label, both["y"] == label["node"]).groupBy("x").agg(F.min("component").alias("seen"))
        # The label of one's label is a shortcut along chains.
        far = label.select(F.col("node").alias("component"), F.col("component").alias("far"))
        after = label.join(seen, label["node"] == seen["x"]).join(far, "component", "left")
        after = after.select("node", F.least("component", "seen", "far").alias("component"), (F.least("component", "seen", "far") < F.col("component")).alias("moved"))
        after = scratch.write(after, "labels")
        moved = not after.where("moved").isEmpty()
        scratch.drop(label)
        label = after.drop("moved")
        label._scratch_path = after._scratch_path
        if not moved:
            return label


def drop_later(pairs: DataFrame, earlier: str, later: str) -> DataFrame:
    """The rows of pairs that come later: each is dropped, whatever became of the earlier one."""
    return pairs.where(F.col(earlier) < F.col(later)).select(F.col(later).alias("dropped")).distinct()


