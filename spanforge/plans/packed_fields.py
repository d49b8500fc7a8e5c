"""Problem 4: the packed fields of the overlay manifest and of the duplicate report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.packed import Packing, unpack
from spanforge.sources.tables import table

OVERLAY = {
    "mapped_classes": ("direct_overlay_manifest.mapped_classes", Packing(",;|/+&\t\n", blank=True)),
    "mapped_class_names": ("direct_overlay_manifest.mapped_class_names", Packing(",;|/\t\n")),
}
GROUPS = {
    "splits": ("cross_split_exact_duplicates.splits", Packing(",;|/+&\t\n")),
    "images": ("cross_split_exact_duplicates.images", Packing(",;|\t\n")),
}


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    overlay = unpack(table(spark, sf_dir, "direct_overlay_manifest"), "overlay_id", OVERLAY)
    groups = unpack(table(spark, sf_dir, "cross_split_exact_duplicates"), "group_id", GROUPS)
    return overlay.unionByName(groups).distinct()


def item_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each value stands at each position of a field."""
    return found(spark, sf_dir).groupBy("field_name", "pos").agg(F.count("*").alias("n_items"), F.countDistinct("item").alias("n_distinct"))


def _sql_field(table_name: str, key: str, column: str, delimiters: str, blank: bool) -> str:
    """Independent of the operator: a delimiter is put before the cell, then a pattern takes each place with the delimiter before it."""
    d = f"[{delimiters}]"
    cell = "trim(cell, ' ')"
    bare = f"CASE WHEN regexp_full_match({cell}, '(?s)\\[.*\\]|\\{{.*\\}}') THEN substr({cell}, 2, length({cell}) - 2) ELSE {cell} END"
    if blank:  # only digits, quotes and delimiters
        bare = f"regexp_replace(regexp_replace(trim(replace({bare}, '\"', ''), ' '), ' *({d}) *', '\\1', 'g'), ' +', ',', 'g')"
    place = rf"({d})((?:\"(?:[^\"\\]|\"\"|\\.)*\"|[^{delimiters}\"])*)"
    value = "trim(place[2:], ' ')"
    unquoted = f"CASE WHEN {value} LIKE '\"%\"' AND length({value}) >= 2 THEN substr({value}, 2, length({value}) - 2) ELSE {value} END"
    item = f"CASE WHEN json_list THEN replace(replace({unquoted}, '\\\"', '\"'), '\\\\', '\\') ELSE replace({unquoted}, '\"\"', '\"') END"
    return f"""SELECT '{table_name}.{column}' AS field_name, row_id, CAST(pos AS INTEGER) AS pos, {item} AS item
      FROM (SELECT row_id, json_list, unnest(places) AS place, generate_subscripts(places, 1) AS pos
            FROM (SELECT row_id, json_list, regexp_extract_all(',' || bare, '{place}') AS places
                  FROM (SELECT row_id, starts_with({cell}, '[') AS json_list, {bare} AS bare
                        FROM (SELECT DISTINCT {key} AS row_id, {column} AS cell FROM {table_name}))
                  WHERE trim(bare, ' ') <> ''))
      WHERE {value} NOT IN ('', '\"\"')"""


FOUND_SQL = "\nUNION\n".join(
    [
        _sql_field("direct_overlay_manifest", "overlay_id", "mapped_classes", r",;|/+&\t\n", True),
        _sql_field("direct_overlay_manifest", "overlay_id", "mapped_class_names", r",;|/\t\n", False),
        _sql_field("cross_split_exact_duplicates", "group_id", "splits", r",;|/+&\t\n", False),
        _sql_field("cross_split_exact_duplicates", "group_id", "images", r",;|\t\n", False),
    ]
)

QUERIES = {"p4_found": found, "p4_item_counts": item_counts}
SQL = {
    "p4_found": FOUND_SQL,
    "p4_item_counts": f"SELECT field_name, pos, count(*) AS n_items, count(DISTINCT item) AS n_distinct FROM ({FOUND_SQL}) GROUP BY ALL",
}
