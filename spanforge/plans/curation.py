"""Sampling, splitting, review, rules, gates and identity over the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import geometry as g
from spanforge.functions import normalize as nz
from spanforge.functions.geometry import col
from spanforge.operators import gates, sampling
from spanforge.plans.boxes import _SQL_TAGS, _sql_pairs, _tags, pairs
from spanforge.sources.fixtures import SQL_GT, SQL_MANIFEST, gt_boxes, manifest, pred_boxes, sql_pred
from spanforge.sources.tables import table

SEED = "20261027"
TARGET, FLOOR = 300, 20


def _sql_fraction(c: str) -> str:
    return f"CAST(CAST('0x' || substr(sha256(CAST({c} AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656"


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in train or external_eval by a digest of their number."""
    split = F.when(sampling.fraction(F.col("doc_id")) < 0.8, "train").otherwise("external_eval")
    return table(spark, sf_dir, "documents").select("doc_id", split.alias("split"))


def hash_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 wide images in hash order."""
    rows = manifest(spark, sf_dir).where("digest is not null and width >= 1920").select("image", "digest")
    return sampling.first_by_hash(rows, F.concat_ws(":", "digest", F.col("image").cast("string")), SEED, 100)


def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of the boxes, whole images together."""
    fold = F.floor(5 * sampling.fraction(F.col("image"))).cast("int")
    return gt_boxes(spark, sf_dir).groupBy(fold.alias("fold")).agg(F.countDistinct("image").alias("n_images"), F.count("*").alias("n_boxes"))


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image with the rarest of its classes (by images that have it; ties: the lesser class); background has -1."""
    boxes = gt_boxes(spark, sf_dir).select("image", "cls").distinct()
    freq = boxes.groupBy("cls").agg(F.count("*").alias("n"))
    rare = boxes.join(F.broadcast(freq), "cls").groupBy("image").agg(F.min(F.struct("n", "cls"))["cls"].alias("stratum"))
    return _tags(spark, sf_dir).select("image").distinct().join(rare, "image", "left").select("image", F.coalesce("stratum", F.lit(-1)).cast("string").alias("stratum"))


_SQL_STRATA = f"""(WITH b AS (SELECT DISTINCT image, cls FROM {SQL_GT}), f AS (SELECT cls, count(*) AS n FROM b GROUP BY cls), r AS (SELECT image, arg_min(cls, (n, cls)) AS stratum FROM b JOIN f USING (cls) GROUP BY image)
    SELECT t.image, CAST(coalesce(stratum, -1) AS VARCHAR) AS stratum FROM (SELECT DISTINCT image FROM {_SQL_TAGS}) t LEFT JOIN r USING (image))"""


def rarest_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n_images"))


def _allocation(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    sizes = {r["stratum"]: r["n_images"] for r in rarest_stratum(spark, sf_dir).collect()}
    return sampling.largest_remainder(sizes, TARGET, FLOOR)


def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(_allocation(spark, sf_dir).items()), "stratum string, n_sampled bigint")


def stratum_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.stratified(_strata(spark, sf_dir), "stratum", "image", _allocation(spark, sf_dir), SEED)
    return rows.select("image", "stratum", F.round("inclusion_probability", 6).alias("inclusion_probability"))


def cluster_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole suppliers, in hash order, until 500 line items are reached."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    order = Window.orderBy(sampling.hash_order(F.col("l_suppkey"), SEED)).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where("before < 500").select("l_suppkey", "n", "before")


def top_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five surest predictions of each class."""
    place = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("conf"), "image", "idx"))
    return pred_boxes(spark, sf_dir).withColumn("place", place).where("place <= 5").select("cls", "place", "image", "idx", F.round("conf", 6).alias("conf"))


def first_per_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest prediction of each image, and of those the 50 surest."""
    best = pred_boxes(spark, sf_dir).groupBy("image").agg(F.max(F.struct("conf", (-F.col("idx")).alias("i"))).alias("b"))
    return best.select("image", (-F.col("b.i")).alias("idx"), F.round("b.conf", 6).alias("conf")).orderBy(F.desc("conf"), "image").limit(50)


def priority_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review queue: validation first, rare classes first, then by confidence; 30 of a class at most; with sequential ids."""
    rows = pred_boxes(spark, sf_dir).join(_tags(spark, sf_dir).select("image", "split"), "image").where("split <> 'train'")
    rank = F.when(F.col("split") == "val", 10).otherwise(0) + F.when(F.col("cls") == 5, 5).when(F.col("cls") == 4, 4).otherwise(0)
    order = [F.desc("rank"), F.desc("conf"), F.col("image"), F.col("idx")]
    capped = rows.withColumn("rank", rank).withColumn("k", F.row_number().over(Window.partitionBy("cls").orderBy(*order))).where("k <= 30")
    number = F.row_number().over(Window.orderBy(*order))  # 180 rows at most
    return capped.select(F.format_string("R%06d", number).alias("review_id"), "split", "cls", "image", "idx", F.round("conf", 6).alias("conf"))


def review_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay images and duplicate reports as one list with an action recommended."""
    direct = table(spark, sf_dir, "direct_overlay_manifest").distinct().select(
        F.lit("direct").alias("candidate_type"), F.col("overlay_id").alias("id"), nz.plain_name(F.col("source")).alias("source"), "target_split", F.when(F.col("n_mapped_boxes") > 0, "KEEP").otherwise("CHECK").alias("recommended_action")
    )
    groups = table(spark, sf_dir, "cross_split_exact_duplicates").distinct().select(F.lit("duplicate").alias("candidate_type"), F.col("group_id").alias("id"), F.lit("report").alias("source"), F.lit("train").alias("target_split"), F.lit("DROP").alias("recommended_action"))
    return direct.unionByName(groups)


def _decision(c: str) -> Column:
    text = F.upper(F.trim(c))
    return F.when(text.isin("KEEP", "DROP"), text).otherwise("")


def decision_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs under review with the decision that was last made, blank if none."""
    rows = table(spark, sf_dir, "test_review").groupBy("pair_id").agg(F.max_by("decision", F.struct("reviewed_at", "decision")).alias("decision"))
    return rows.select("pair_id", _decision("decision").alias("decision"))


def review_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of overlays: blank ones of train are pending; only if none is, other splits are dropped."""
    rows = table(spark, sf_dir, "direct_overlay_manifest").select("overlay_id", "target_split", "license_note").distinct()
    made = rows.groupBy("overlay_id").agg(F.max("target_split").alias("target_split"), F.max(F.when(F.col("license_note") == "internal use", "KEEP").when(F.col("license_note") == "research only", "DROP").otherwise("")).alias("decision"))
    pending = made.agg(F.count_if((F.col("target_split") == "train") & (F.col("decision") == "")).alias("n_pending"))
    status = F.when((F.col("target_split") == "train") & (F.col("decision") == ""), "PENDING").when((F.col("n_pending") == 0) & (F.col("target_split") != "train"), "DROP").when(F.col("decision") == "", "BLOCKED").otherwise(F.col("decision"))
    return made.crossJoin(F.broadcast(pending)).select("overlay_id", status.alias("status"))


def last_decision_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows by id: the last record stays."""
    rows = table(spark, sf_dir, "audit_records").groupBy("rid").agg(F.max("recorded_at").alias("recorded_at"), F.max_by("n_boxes", F.struct("recorded_at", "n_boxes")).alias("n_boxes"), F.count("*").alias("n_rows"))
    return rows.select("rid", F.date_format("recorded_at", "yyyy-MM-dd HH:mm:ss").alias("recorded_at"), "n_boxes", "n_rows")


def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches and sources as a matrix: complete, in progress or pending."""
    rows = table(spark, sf_dir, "direct_overlay_manifest").distinct().withColumn("source", nz.plain_name(F.col("source")))
    done = rows.groupBy("source", "batch_no").agg(F.count("*").alias("n"), F.count_if(F.col("n_mapped_boxes") > 0).alias("k"))
    dims = table(spark, sf_dir, "source_registry").select(F.col("dataset").alias("source")).crossJoin(F.broadcast(table(spark, sf_dir, "direct_overlay_manifest").select("batch_no").distinct()))
    status = F.when(F.col("n").isNull(), "PENDING").when(F.col("k") == F.col("n"), "COMPLETED").otherwise("IN_PROGRESS")
    return dims.join(done, ["source", "batch_no"], "left").select("source", "batch_no", status.alias("status"))


def rule_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rules in their order (flip, tiny, add nest, refine by class map) and the log of what each has changed."""
    gt = gt_boxes(spark, sf_dir)
    flipped = gt.where("image % 13 = 0").select("image", F.lit("A").alias("rule"), F.count("*").over(Window.partitionBy("image")).alias("n")).distinct()
    turned = gt.withColumn("cx", F.when(F.col("image") % 13 == 0, 1 - F.col("cx")).otherwise(F.col("cx")))
    tiny = turned.where("least(w, h) < 0.2")
    kept = turned.where("least(w, h) >= 0.2")
    nest = pred_boxes(spark, sf_dir).where("cls = 3 and conf >= 0.6")
    met = pairs(nest, kept, "p_", "g_", "left").groupBy("image", "p_idx").agg(F.coalesce(F.max(col(g.iou("p_", "g_"))), F.lit(0.0)).alias("best"))
    added = met.where("best < 0.3")
    log = flipped.unionByName(tiny.groupBy("image").agg(F.count("*").alias("n")).withColumn("rule", F.lit("F"))).unionByName(added.groupBy("image").agg(F.count("*").alias("n")).withColumn("rule", F.lit("B")))
    return log.groupBy("rule").agg(F.count("*").alias("n_images"), F.sum("n").alias("n_changes"))


def person_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of class 4 that a sure prediction of class 5 covers are dropped; boxes that cover no label are added."""
    gt, person = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir, 1).where("cls = 5 and conf >= 0.6")
    dropped = pairs(gt.where("cls = 4"), person, "g_", "p_").where(col(f"{g.iou('g_', 'p_')} >= 0.2")).select("image", F.col("g_idx").alias("idx"), F.lit("dropped").alias("change")).distinct()
    covers = pairs(person, gt, "p_", "g_", "left").groupBy("image", "p_idx").agg(F.coalesce(F.max(col(g.ioa("g_", "p_"))), F.lit(0.0)).alias("most"))
    return dropped.unionByName(covers.where("most <= 0.2").select("image", F.col("p_idx").alias("idx"), F.lit("added").alias("change")))


def tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of two models with nearly the same centre: the first hit replaces."""
    a, b = pred_boxes(spark, sf_dir, 0), pred_boxes(spark, sf_dir, 2)
    near = pairs(a, b, "a_", "b_", same_class=True).where("abs(a_cx - b_cx) < 0.025 and abs(a_cy - b_cy) < 0.025")
    return near.groupBy("image", "a_idx").agg(F.min("b_idx").alias("b_idx"), F.count("*").alias("n_hits"))


def class_drop_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class 0 leaves, the others move down by one."""
    return gt_boxes(spark, sf_dir).where("cls > 0").select("image", "idx", (F.col("cls") - 1).alias("cls"))


def label_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files as text and their digest: eight digits, sorted lines, boxes without extent left out."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h")
    rows = gt_boxes(spark, sf_dir).where("w > 0 and h > 0").groupBy("image").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.select("image", F.sha2(F.array_join("lines", "\n"), 256).alias("digest"), F.size("lines").alias("n_boxes"))


def dataset_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag of twelve hex digits for each dataset, from a digest of the sum of the digests of its images; order doesn't matter."""
    rows = manifest(spark, sf_dir).where("digest is not null and dataset is not null").select("dataset", "digest").distinct()
    part = F.conv(F.substring("digest", 1, 12), 16, 10).cast("decimal(38,0)")
    sums = rows.groupBy("dataset").agg(F.sum(part).alias("s"), F.count("*").alias("n_images"))
    return sums.select("dataset", "n_images", F.concat(F.lit("set_"), F.substring(F.sha2(F.concat_ws(":", "dataset", F.col("s").cast("string"), F.col("n_images").cast("string")), 256), 1, 12)).alias("tag"))


def gate_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the image list and of the overlay manifest that break a rule."""
    images = table(spark, sf_dir, "image_sha256").distinct()
    a = gates.problems(images.select(F.col("manifest_index").alias("id"), "sha256", "split", "width", "height"), ["id"], {"no_digest": nz.plain_digest(F.col("sha256")).isNull(), "no_split": nz.plain_split(F.col("split")).isNull(), "no_size": (F.col("width") <= 0) | (F.col("height") <= 0)})
    overlay = table(spark, sf_dir, "direct_overlay_manifest").distinct()
    b = gates.problems(overlay.select(F.col("overlay_id").alias("id"), "target_split", "n_mapped_boxes", "source"), ["id"], {"bad_target": ~F.col("target_split").isin("train", "external_eval"), "no_boxes": F.coalesce(F.col("n_mapped_boxes"), F.lit(0)) <= 0, "no_source": nz.plain_name(F.col("source")).isNull()})
    return a.withColumn("tab", F.lit("image")).unionByName(b.withColumn("tab", F.lit("overlay"))).groupBy("tab", "problem").agg(F.count("*").alias("n"))


def manifest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the audit that the image list doesn't have, and the other way round."""
    images = table(spark, sf_dir, "image_sha256").select(F.col("manifest_index").alias("id")).distinct()
    audit = table(spark, sf_dir, "audit_records").select(F.col("rid").alias("id")).distinct()
    both = images.join(audit, "id", "left_anti").withColumn("side", F.lit("no_audit")).unionByName(audit.join(images, "id", "left_anti").withColumn("side", F.lit("no_image")))
    return both.groupBy("side").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def nested_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of events by type."""
    rows = table(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k bigint"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p.k").alias("n_k"), F.sum("p.k").alias("sum_k"), F.max("p.k").alias("max_k"))


def keyword_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class names of overlays by keywords: the first rule that a name holds wins."""
    words = F.translate(F.lower(F.col("mapped_class_names")), "_-", "  ")
    kind = F.when(words.contains("flashover") | words.contains("arc"), "burnt").when(words.contains("broken") | words.contains("strand"), "broken").when(words.contains("nest"), "nest").when(words.contains("insulator"), "sound").otherwise("other")
    return table(spark, sf_dir, "direct_overlay_manifest").distinct().groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where images come from: the root and the campaign in the path."""
    rows = table(spark, sf_dir, "image_sha256").distinct()
    path = F.translate("image", "\\", "/")
    root = F.when(path.startswith("/mnt/"), "mount").when(path.startswith("./"), "relative").otherwise("plain")
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return rows.groupBy(root.alias("root"), ext.alias("extension")).agg(F.count("*").alias("n"), F.countDistinct(nz.path_part(F.col("image"), 3)).alias("n_campaigns"))


QUERIES = {
    f.__name__: f
    for f in (
        hash_split, hash_pool, grouped_folds, rarest_stratum, largest_remainder, stratum_sample, cluster_draw, top_per_class, first_per_image, priority_caps, review_manifest, decision_template, review_resolve,
        last_decision_wins, stage_status, rule_changes, person_rule, tolerance_join, class_drop_remap, label_digest, dataset_tags, gate_violations, manifest_difference, nested_props, keyword_notes, provenance,
    )
}

_IMG = "(SELECT DISTINCT * FROM image_sha256)"
_OVL = "(SELECT DISTINCT * FROM direct_overlay_manifest)"
_KEPT = f"(SELECT image, idx, cls, CASE WHEN image % 13 = 0 THEN 1 - cx ELSE cx END AS cx, cy, w, h FROM {SQL_GT} WHERE least(w, h) >= 0.2)"
_NEST = f"(SELECT * FROM {sql_pred(0)} WHERE cls = 3 AND conf >= 0.6)"
_PERSON = f"(SELECT * FROM {sql_pred(1)} WHERE cls = 5 AND conf >= 0.6)"
_GT4 = f"(SELECT * FROM {SQL_GT} WHERE cls = 4)"
_WORDS = "translate(lower(mapped_class_names), '_-', '  ')"

SQL = {
    "hash_split": f"SELECT doc_id, CASE WHEN {_sql_fraction('doc_id')} < 0.8 THEN 'train' ELSE 'external_eval' END AS split FROM documents",
    "hash_pool": f"SELECT image, digest FROM {SQL_MANIFEST} WHERE digest IS NOT NULL AND width >= 1920 ORDER BY sha256(digest || ':' || CAST(image AS VARCHAR) || '{SEED}') LIMIT 100",
    "grouped_folds": f"SELECT CAST(floor(5 * {_sql_fraction('image')}) AS INTEGER) AS fold, count(DISTINCT image) AS n_images, count(*) AS n_boxes FROM {SQL_GT} GROUP BY 1",
    "rarest_stratum": f"SELECT stratum, count(*) AS n_images FROM {_SQL_STRATA} GROUP BY stratum",
    "largest_remainder": f"""WITH s AS (SELECT stratum, count(*) AS n FROM {_SQL_STRATA} GROUP BY stratum), f AS (SELECT *, least(n, {FLOOR}) AS base FROM s), r AS (SELECT *, ({TARGET} - sum(base) OVER ()) * n / sum(n) OVER () AS exact FROM f),
        k AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, stratum) AS k, ({TARGET} - sum(base) OVER ()) - sum(floor(exact)) OVER () AS left_over FROM r)
        SELECT stratum, CAST(base + floor(exact) + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS BIGINT) AS n_sampled FROM k""",
    "cluster_draw": f"""SELECT l_suppkey, n, CAST(before AS BIGINT) AS before FROM (SELECT l_suppkey, n, coalesce(sum(n) OVER (ORDER BY sha256(CAST(l_suppkey AS VARCHAR) || '{SEED}') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey)) WHERE before < 500""",
    "top_per_class": f"SELECT cls, CAST(place AS INTEGER) AS place, image, idx, round(conf, 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY conf DESC, image, idx) AS place FROM {sql_pred(0)}) WHERE place <= 5",
    "first_per_image": f"SELECT image, idx, round(conf, 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, idx) AS k FROM {sql_pred(0)}) WHERE k = 1 ORDER BY conf DESC, image LIMIT 50",
    "priority_caps": f"""WITH r AS (SELECT p.*, split, CASE WHEN split = 'val' THEN 10 ELSE 0 END + CASE WHEN cls = 5 THEN 5 WHEN cls = 4 THEN 4 ELSE 0 END AS rank FROM {sql_pred(0)} p JOIN (SELECT image, split FROM {_SQL_TAGS}) USING (image) WHERE split <> 'train'),
        k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY rank DESC, conf DESC, image, idx) AS k FROM r) WHERE k <= 30)
        SELECT printf('R%06d', row_number() OVER (ORDER BY rank DESC, conf DESC, image, idx)) AS review_id, split, cls, image, idx, round(conf, 6) AS conf FROM k""",
    "review_manifest": f"""SELECT 'direct' AS candidate_type, overlay_id AS id, {nz.sql_name('source')} AS source, target_split, CASE WHEN n_mapped_boxes > 0 THEN 'KEEP' ELSE 'CHECK' END AS recommended_action FROM {_OVL}
        UNION ALL SELECT 'duplicate', group_id, 'report', 'train', 'DROP' FROM (SELECT DISTINCT * FROM cross_split_exact_duplicates)""",
    "decision_template": "SELECT pair_id, CASE WHEN upper(trim(decision)) IN ('KEEP', 'DROP') THEN upper(trim(decision)) ELSE '' END AS decision FROM (SELECT pair_id, arg_max(decision, (reviewed_at, decision)) AS decision FROM test_review GROUP BY pair_id)",
    "review_resolve": """WITH m AS (SELECT overlay_id, max(target_split) AS target_split, max(CASE license_note WHEN 'internal use' THEN 'KEEP' WHEN 'research only' THEN 'DROP' ELSE '' END) AS decision FROM direct_overlay_manifest GROUP BY overlay_id),
        p AS (SELECT count(*) FILTER (target_split = 'train' AND decision = '') AS n FROM m)
        SELECT overlay_id, CASE WHEN target_split = 'train' AND decision = '' THEN 'PENDING' WHEN n = 0 AND target_split <> 'train' THEN 'DROP' WHEN decision = '' THEN 'BLOCKED' ELSE decision END AS status FROM m, p""",
    "last_decision_wins": "SELECT rid, strftime(max(recorded_at), '%Y-%m-%d %H:%M:%S') AS recorded_at, arg_max(n_boxes, (recorded_at, n_boxes)) AS n_boxes, count(*) AS n_rows FROM audit_records GROUP BY rid",
    "stage_status": f"""WITH d AS (SELECT {nz.sql_name('source')} AS source, batch_no, count(*) AS n, count(*) FILTER (n_mapped_boxes > 0) AS k FROM {_OVL} GROUP BY 1, 2)
        SELECT r.dataset AS source, b.batch_no, CASE WHEN n IS NULL THEN 'PENDING' WHEN k = n THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS status FROM source_registry r CROSS JOIN (SELECT DISTINCT batch_no FROM direct_overlay_manifest) b LEFT JOIN d ON d.source = r.dataset AND d.batch_no = b.batch_no""",
    "rule_changes": f"""WITH kept AS MATERIALIZED (SELECT * FROM {_KEPT}), n AS MATERIALIZED (SELECT * FROM {_NEST}), l AS (SELECT 'A' AS rule, image, count(*) AS n FROM {SQL_GT} WHERE image % 13 = 0 GROUP BY image
        UNION ALL SELECT 'F', image, count(*) FROM {SQL_GT} WHERE least(w, h) < 0.2 GROUP BY image
        UNION ALL SELECT 'B', image, count(*) FROM (SELECT image, p_idx FROM (SELECT * FROM {_sql_pairs('n', 'kept', 'p_', 'g_', 'LEFT JOIN', 'idx cls cx cy w h conf', 'idx cls cx cy w h')}) GROUP BY image, p_idx HAVING coalesce(max({g.iou('p_', 'g_')}), 0) < 0.3) GROUP BY image)
        SELECT rule, count(*) AS n_images, CAST(sum(n) AS BIGINT) AS n_changes FROM l GROUP BY rule""",
    "person_rule": f"""SELECT DISTINCT image, g_idx AS idx, 'dropped' AS change FROM {_sql_pairs(_GT4, _PERSON, 'g_', 'p_')} WHERE {g.iou('g_', 'p_')} >= 0.2
        UNION ALL SELECT image, p_idx, 'added' FROM (SELECT * FROM {_sql_pairs(_PERSON, SQL_GT, 'p_', 'g_', 'LEFT JOIN', 'idx cls cx cy w h conf', 'idx cls cx cy w h')}) GROUP BY image, p_idx HAVING coalesce(max({g.ioa('g_', 'p_')}), 0) <= 0.2""",
    "tolerance_join": f"""SELECT image, a_idx, min(b_idx) AS b_idx, count(*) AS n_hits FROM {_sql_pairs(sql_pred(0), sql_pred(2), 'a_', 'b_')} WHERE a_cls = b_cls AND abs(a_cx - b_cx) < 0.025 AND abs(a_cy - b_cy) < 0.025 GROUP BY image, a_idx""",
    "class_drop_remap": f"SELECT image, idx, cls - 1 AS cls FROM {SQL_GT} WHERE cls > 0",
    "label_digest": f"SELECT image, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest, CAST(count(*) AS INTEGER) AS n_boxes FROM (SELECT image, printf('%d %.6f %.6f %.6f %.6f', cls, cx, cy, w, h) AS line FROM {SQL_GT} WHERE w > 0 AND h > 0) GROUP BY image",
    "dataset_tags": f"""SELECT dataset, n_images, 'set_' || substr(sha256(dataset || ':' || CAST(s AS VARCHAR) || ':' || CAST(n_images AS VARCHAR)), 1, 12) AS tag
        FROM (SELECT dataset, sum(CAST('0x' || substr(digest, 1, 12) AS BIGINT)) AS s, count(*) AS n_images FROM (SELECT DISTINCT dataset, digest FROM {SQL_MANIFEST} WHERE digest IS NOT NULL AND dataset IS NOT NULL) GROUP BY dataset)""",
    "gate_violations": f"""WITH i AS (SELECT {nz.sql_digest('sha256')} AS d, {nz.sql_split('split')} AS s, width, height FROM {_IMG}), o AS (SELECT target_split, n_mapped_boxes, {nz.sql_name('source')} AS s FROM {_OVL})
        SELECT * FROM (SELECT 'image' AS tab, 'no_digest' AS problem, count(*) FILTER (d IS NULL) AS n FROM i UNION ALL SELECT 'image', 'no_split', count(*) FILTER (s IS NULL) FROM i UNION ALL SELECT 'image', 'no_size', count(*) FILTER (width <= 0 OR height <= 0) FROM i
        UNION ALL SELECT 'overlay', 'bad_target', count(*) FILTER (target_split NOT IN ('train', 'external_eval')) FROM o UNION ALL SELECT 'overlay', 'no_boxes', count(*) FILTER (coalesce(n_mapped_boxes, 0) <= 0) FROM o UNION ALL SELECT 'overlay', 'no_source', count(*) FILTER (s IS NULL) FROM o) WHERE n > 0""",
    "manifest_difference": """SELECT 'no_audit' AS side, count(DISTINCT manifest_index) AS n, min(manifest_index) AS first_id FROM image_sha256 WHERE manifest_index NOT IN (SELECT rid FROM audit_records)
        UNION ALL SELECT 'no_image', count(DISTINCT rid), min(rid) FROM audit_records WHERE rid NOT IN (SELECT manifest_index FROM image_sha256)""",
    "nested_props": "SELECT event_type, count(*) AS n, count(k) AS n_k, CAST(sum(k) AS BIGINT) AS sum_k, max(k) AS max_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "keyword_notes": f"""SELECT CASE WHEN contains({_WORDS}, 'flashover') OR contains({_WORDS}, 'arc') THEN 'burnt' WHEN contains({_WORDS}, 'broken') OR contains({_WORDS}, 'strand') THEN 'broken' WHEN contains({_WORDS}, 'nest') THEN 'nest' WHEN contains({_WORDS}, 'insulator') THEN 'sound' ELSE 'other' END AS kind,
        count(*) AS n FROM {_OVL} GROUP BY 1""",
    "provenance": f"""SELECT CASE WHEN starts_with(p, '/mnt/') THEN 'mount' WHEN starts_with(p, './') THEN 'relative' ELSE 'plain' END AS root, lower(regexp_extract(p, '\\.([A-Za-z]+)$', 1)) AS extension, count(*) AS n, count(DISTINCT {nz.sql_path_part('image', 3)}) AS n_campaigns
        FROM (SELECT *, replace(image, '\\', '/') AS p FROM {_IMG}) GROUP BY 1, 2""",
}
SQL["stratum_sample"] = f"""WITH a AS ({SQL['largest_remainder']}), s AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY {_sql_fraction(f"CAST(image AS VARCHAR) || '{SEED}'")}, image) AS k FROM {_SQL_STRATA})
    SELECT image, stratum, round(n_sampled / n, 6) AS inclusion_probability FROM s JOIN a USING (stratum) WHERE k <= n_sampled"""
