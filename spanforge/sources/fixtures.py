"""The domain relations, derived from the project's tables; each has a twin in SQL.

All numbers come from integer arithmetic followed by one double division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import normalize as nz
from spanforge.sources.tables import table

#: The taxonomy in its order.
TAXONOMY = ("insulator", "insulator_broken", "insulator_flashover", "bird_nest", "foreign_object", "broken_strand")

_LINE_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    return table(spark, sf_dir, "lineitem").withColumn("idx", (F.row_number().over(order) - 1).cast("int"))


def gt_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, idx, cls, cx, cy, w, h): one labelled box per line item, its image the order."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("image"), "idx", (p % 6).cast("int").alias("cls"), ((p % 997) / 997).alias("cx"), ((s % 89) / 89).alias("cy"),
        ((F.col("l_quantity") + 2) / 60).alias("w"), ((p % 31 + 10) / 60).alias("h"),
    )


def pred_boxes(spark: SparkSession, sf_dir: str, model: int = 0) -> DataFrame:
    """(image, idx, cls, cx, cy, w, h, conf): the boxes of a model, moved, sometimes of another class or left out."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    cls = F.when(p % 11 == 0, (p + 1) % 6).otherwise(p % 6).cast("int")
    rows = _lines(spark, sf_dir).where(F.col("idx") % 5 != model + 1)
    return rows.select(
        F.col("l_orderkey").alias("image"), "idx", cls.alias("cls"), ((p % 997) / 997 + ((s + model) % 7 - 3) / 100).alias("cx"), ((s % 89) / 89 + ((s + model) % 5 - 2) / 100).alias("cy"),
        ((F.col("l_quantity") + 2) / 60).alias("w"), ((p % 31 + 10) / 60).alias("h"), ((p * 7919 + 31 * model) % 1000 / 1000).alias("conf"),
    )


_SQL_LINES = f"(SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS INTEGER) AS idx FROM lineitem)"
SQL_GT = f"""(SELECT l_orderkey AS image, idx, CAST(l_partkey % 6 AS INTEGER) AS cls, (l_partkey % 997) / 997::DOUBLE AS cx, (l_suppkey % 89) / 89::DOUBLE AS cy,
    (l_quantity + 2) / 60::DOUBLE AS w, (l_partkey % 31 + 10) / 60::DOUBLE AS h FROM {_SQL_LINES})"""


def sql_pred(model: int = 0) -> str:
    return f"""(SELECT l_orderkey AS image, idx, CAST(CASE WHEN l_partkey % 11 = 0 THEN (l_partkey + 1) % 6 ELSE l_partkey % 6 END AS INTEGER) AS cls,
    (l_partkey % 997) / 997::DOUBLE + ((l_suppkey + {model}) % 7 - 3) / 100::DOUBLE AS cx, (l_suppkey % 89) / 89::DOUBLE + ((l_suppkey + {model}) % 5 - 2) / 100::DOUBLE AS cy,
    (l_quantity + 2) / 60::DOUBLE AS w, (l_partkey % 31 + 10) / 60::DOUBLE AS h, ((l_partkey * 7919 + 31 * {model}) % 1000) / 1000::DOUBLE AS conf
    FROM {_SQL_LINES} WHERE idx % 5 <> {model + 1})"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, path, split, digest, dataset, width, height) of the image list, in plain form."""
    split = F.coalesce(nz.plain_split(F.col("split")), nz.plain_split(nz.path_part(F.col("image"), 1)))
    rows = table(spark, sf_dir, "image_sha256").select(
        F.col("manifest_index").alias("image"), F.col("image").alias("path"), split.alias("split"), nz.plain_digest(F.col("sha256")).alias("digest"),
        nz.plain_name(nz.path_part(F.col("image"), 2)).alias("dataset"), "width", "height",
    )
    return rows.distinct()


SQL_MANIFEST = f"""(SELECT DISTINCT manifest_index AS image, image AS path, coalesce({nz.sql_split('split')}, {nz.sql_split(nz.sql_path_part('image', 1))}) AS split,
    {nz.sql_digest('sha256')} AS digest, {nz.sql_name(nz.sql_path_part('image', 2))} AS dataset, width, height FROM image_sha256)"""


def sign_hashes(spark: SparkSession, sf_dir: str, first: int = 0, bits: int = 24) -> DataFrame:
    """(vec_id, hash, embedding): one bit per sign of ``bits`` dimensions from ``first`` on."""
    value = F.lit(0).cast("bigint")
    for i in range(bits):
        value = value.bitwiseOR(F.when(F.col("embedding")[first + i] > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return table(spark, sf_dir, "embeddings").select("vec_id", value.alias("hash"), "embedding")


def sql_signs(first: int = 0, bits: int = 24) -> str:
    value = " + ".join(f"CASE WHEN embedding[{first + i + 1}] > 0 THEN {1 << i} ELSE 0 END" for i in range(bits))
    return f"(SELECT vec_id, CAST({value} AS BIGINT) AS hash, embedding FROM embeddings)"
