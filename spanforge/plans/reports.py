"""Regions of interest, threshold grids, review keys, name rules and other small relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import geometry as g
from spanforge.functions import normalize as nz
from spanforge.functions.geometry import col
from spanforge.plans.boxes import _masked, _sql_pairs, pairs, sql_masked
from spanforge.sources.fixtures import SQL_GT, gt_boxes, pred_boxes, sql_pred
from spanforge.sources.tables import table

GROW, LEAST_SIDE = 1.2, 0.3
CUTS = (0.1, 0.3, 0.5, 0.7, 0.9)


def _roi(grow: str, least: str, axis: str) -> str:
    """Side of the region around a box: grown, not below a least side, and cut evenly where it passes the edge of the image."""
    centre, side = ("cx", "w") if axis == "x" else ("cy", "h")
    return f"least(greatest({side} * {grow}, {least}), 2 * least({centre}, 1 - {centre}))"


def roi_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions around labels; those that had to be cut are marked."""
    w, h = _roi(str(GROW), str(LEAST_SIDE), "x"), _roi(str(GROW), str(LEAST_SIDE), "y")
    rows = gt_boxes(spark, sf_dir)
    cut = (col(f"{w} < w * {GROW} - 0.000005")) | (col(f"{h} < h * {GROW} - 0.000005"))
    return rows.select("image", "idx", F.round(col(w), 9).alias("roi_w"), F.round(col(h), 9).alias("roi_h"), cut.alias("cut"))


def roi_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of several sizes: how many hold the whole label, what they cost in area, and a balance of both."""
    params = spark.createDataFrame([(e, m) for e in (1.0, 1.2, 1.4, 1.6) for m in (0.1, 0.3, 0.5)], "grow double, least double")
    w, h = _roi("grow", "least", "x"), _roi("grow", "least", "y")
    rows = gt_boxes(spark, sf_dir).crossJoin(F.broadcast(params))  # twelve rows of parameters
    held = (col(f"{w} >= w - 0.000005") & col(f"{h} >= h - 0.000005")).cast("int")
    out = rows.groupBy("grow", "least").agg(F.avg(held).alias("held"), F.avg(col(f"greatest({w}, 0) * greatest({h}, 0) / (w * h)")).alias("ratio"))
    return out.select("grow", "least", F.round("held", 6).alias("held"), F.round("ratio", 6).alias("ratio"), F.round(F.col("held") - 0.035 * F.greatest(F.lit(0.0), F.col("ratio") - 1), 6).alias("balanced"))


def f1_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 per class of two models at a confidence of 0.25, and the difference as text."""
    totals = gt_boxes(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("npos"))
    out = totals
    for k in (0, 1):
        m = _masked(spark, sf_dir, model=k).where("conf >= 0.25").groupBy("cls").agg(F.sum("tp").alias("t"), F.count("*").alias("n"))
        p, r = F.col("t") / F.col("n"), F.col("t") / F.col("npos")
        out = out.join(m, "cls", "left").withColumn(f"f{k}", 2 * p * r / (p + r + 1e-8)).drop("t", "n")
    delta = F.coalesce(F.format_string("%+.3f", F.col("f1") - F.col("f0")), F.lit("N/A"))
    return out.select("cls", F.round("f0", 6).alias("f1_base"), F.round("f1", 6).alias("f1_candidate"), delta.alias("delta"))


def size_and_log_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of size, and logs of area and of the size relative to the mean of the image."""
    rows = gt_boxes(spark, sf_dir).withColumn("area", col(g.area()))
    mean = rows.groupBy("image").agg(F.avg("area").alias("mean_area"))
    tag = F.when(F.col("area") < 0.05, "small").when(F.col("area") < 0.2, "medium").otherwise("large")
    return rows.join(mean, "image").select("image", "idx", tag.alias("size"), F.round(F.log("area"), 6).alias("log_area"), (F.round(F.log(F.col("area") / F.col("mean_area")), 6) + F.lit(0.0)).alias("log_scale"), (F.col("cls") == 4).cast("double").alias("is_foreign"))


def shrink_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions inside a label of their class, with a slack of 2 %, that would make it smaller."""
    both = pairs(gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir, 1), "g_", "p_", same_class=True)
    a, b = g.corners("p_"), g.corners("g_")
    inside = col(f"{a['x1']} >= {b['x1']} - 0.02 * g_w AND {a['y1']} >= {b['y1']} - 0.02 * g_h AND {a['x2']} <= {b['x2']} + 0.02 * g_w AND {a['y2']} <= {b['y2']} + 0.02 * g_h")
    return both.withColumn("iou", F.round(col(g.iou("g_", "p_")), 9)).where(inside & (F.col("iou") >= 0.5) & (F.col("iou") < 0.85)).select("image", "g_idx", "p_idx", "iou")


def verdict_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test images that no pair under review excludes."""
    rows = table(spark, sf_dir, "test_review").select(nz.plain_digest(F.col("test_sha256")).alias("digest"), F.upper(F.trim("decision")).alias("decision")).where("digest is not null")
    return rows.groupBy("digest").agg(F.count_if(F.coalesce(F.col("decision"), F.lit("")) != "KEEP").alias("n_against"), F.count("*").alias("n_pairs")).where("n_against = 0").select("digest", "n_pairs")


def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class the cut of the confidence with the most recall among those with enough precision; ties by precision, then the lower cut."""
    totals = gt_boxes(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("npos"))
    rows = _masked(spark, sf_dir).select("*", F.explode(F.array(*[F.lit(c) for c in CUTS])).alias("cut")).where("conf >= cut")
    grid = rows.groupBy("cls", "cut").agg(F.sum("tp").alias("t"), F.count("*").alias("n")).join(totals, "cls").withColumn("p", F.col("t") / F.col("n")).withColumn("r", F.col("t") / F.col("npos"))
    best = grid.where("p >= 0.5").groupBy("cls").agg(F.max(F.struct("r", "p", (-F.col("cut")).alias("c"))).alias("b"))
    return best.select("cls", (-F.col("b.c")).alias("cut"), F.round("b.p", 6).alias("precision"), F.round("b.r", 6).alias("recall"))


def small_object_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose largest box of a class is small: the share with any sure prediction of the class."""
    small = gt_boxes(spark, sf_dir).groupBy("image", "cls").agg(F.max(col(g.area())).alias("a")).where("a < 0.1")
    hits = pred_boxes(spark, sf_dir).where("conf >= 0.25").select("image", "cls", F.lit(1).alias("hit")).distinct()
    return small.join(hits, ["image", "cls"], "left").groupBy("cls").agg(F.count("*").alias("n_images"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def head_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of each source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", nz.plain_label(F.col("source")).alias("source")).where("source is not null")
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return rows.withColumn("place", place).where("place <= 3")


def top_of_several(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes among the 40 greatest by any of three scores, once each, with the scores that chose them."""
    rows = pred_boxes(spark, sf_dir).select("image", "idx", "conf", col(g.area()).alias("area"), col("greatest(w / h, h / w)").alias("aspect"))
    out = None
    for name in ("conf", "area", "aspect"):
        part = rows.orderBy(F.desc(F.round(name, 9)), "image", "idx").limit(40).select("image", "idx", F.lit(name).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("image", "idx").agg(F.array_join(F.array_sort(F.collect_set("score")), ",").alias("scores"))


def item_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys image:class:index, counted per image and class."""
    place = F.row_number().over(Window.partitionBy("image", "cls").orderBy("idx")) - 1
    return gt_boxes(spark, sf_dir).select("image", "idx", F.concat_ws(":", F.col("image").cast("string"), F.col("cls").cast("string"), place.cast("string")).alias("item_key"))


def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of hits among the first 50 and 200 predictions of two models."""
    out = None
    for k in (0, 1):
        part = _masked(spark, sf_dir, model=k).orderBy(F.desc("conf"), "image", "idx").limit(200).withColumn("model", F.lit(k))
        out = part if out is None else out.unionByName(part)
    place = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("conf"), "image", "idx"))  # 200 rows each
    ranked = out.withColumn("k", place)
    return ranked.groupBy("model").agg(F.round(F.avg(F.when(F.col("k") <= 50, F.col("tp"))), 6).alias("p_at_50"), F.round(F.avg("tp"), 6).alias("p_at_200"))


def override_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perceptual hash of each image: that of the audit where there is one, else its own."""
    own = table(spark, sf_dir, "image_sha256").groupBy("manifest_index").agg(F.max(nz.hash_bits(F.col("phash"))).alias("own"))
    audit = table(spark, sf_dir, "audit_records").groupBy(F.col("rid").alias("manifest_index")).agg(F.max_by(nz.hash_bits(F.col("phash")), F.struct("recorded_at", "phash")).alias("audit"))
    both = own.join(audit, "manifest_index", "left")
    origin = F.when(F.col("audit").isNotNull(), "audit").when(F.col("own").isNotNull(), "image").otherwise("none")
    return both.select("manifest_index", F.coalesce("audit", "own").alias("hash"), origin.alias("origin"))


def overlay_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlay images whose name isn't made of their dataset and digest, and pairs of image and label with different stems."""
    rows = table(spark, sf_dir, "direct_overlay_manifest").distinct()
    stem = lambda c: F.regexp_extract(c, r"([^/\\]+)\.[A-Za-z]+$", 1)
    wanted = F.concat_ws("_", nz.plain_name(F.col("source")), F.substring(nz.plain_digest(F.col("source_sha256")), 1, 16))
    return rows.agg(F.count("*").alias("n"), F.count_if(stem(F.col("overlay_image")) == wanted).alias("n_by_content"), F.count_if(stem(F.col("overlay_image")) == stem(F.col("overlay_label"))).alias("n_paired"), F.countDistinct("overlay_image").alias("n_images"))


QUERIES = {
    f.__name__: f
    for f in (
        roi_policy, roi_sweep, f1_deltas, size_and_log_features, shrink_only, verdict_exclusion, threshold_grid, small_object_recall, head_per_source, top_of_several, item_keys, precision_at_k, override_coalesce, overlay_names,
    )
}

_W, _H = _roi(str(GROW), str(LEAST_SIDE), "x"), _roi(str(GROW), str(LEAST_SIDE), "y")
_SW, _SH = _roi("grow", "least_side", "x"), _roi("grow", "least_side", "y")
_A, _B = g.corners("p_"), g.corners("g_")
_P0 = sql_pred(0)


def _sql_f1(model: int) -> str:
    return f"(SELECT cls, 2 * p * r / (p + r + 1e-8) AS f FROM (SELECT cls, sum(tp) / count(*) AS p, sum(tp) / any_value(npos) AS r FROM {sql_masked(0.5, model)} JOIN (SELECT cls, count(*) AS npos FROM {SQL_GT} GROUP BY cls) USING (cls) WHERE conf >= 0.25 GROUP BY cls))"


def _sql_top(model: int) -> str:
    return f"(SELECT {model} AS model, tp, row_number() OVER (ORDER BY conf DESC, image, idx) AS k FROM {sql_masked(0.5, model)})"


SQL = {
    "roi_policy": f"SELECT image, idx, round({_W}, 9) AS roi_w, round({_H}, 9) AS roi_h, {_W} < w * {GROW} - 0.000005 OR {_H} < h * {GROW} - 0.000005 AS cut FROM {SQL_GT}",
    "roi_sweep": f"""SELECT grow, least, round(held, 6) AS held, round(ratio, 6) AS ratio, round(held - 0.035 * greatest(0, ratio - 1), 6) AS balanced FROM (SELECT grow, least_side AS least, avg(CAST({_SW} >= w - 0.000005 AND {_SH} >= h - 0.000005 AS INTEGER)) AS held,
        avg(greatest({_SW}, 0) * greatest({_SH}, 0) / (w * h)) AS ratio FROM {SQL_GT}, (SELECT CAST(unnest([1.0, 1.2, 1.4, 1.6]) AS DOUBLE) AS grow), (SELECT CAST(unnest([0.1, 0.3, 0.5]) AS DOUBLE) AS least_side) GROUP BY grow, least_side)""",
    "f1_deltas": f"SELECT cls, round(a.f, 6) AS f1_base, round(b.f, 6) AS f1_candidate, printf('%+.3f', b.f - a.f) AS delta FROM {_sql_f1(0)} a JOIN {_sql_f1(1)} b USING (cls)",
    "size_and_log_features": f"""SELECT image, idx, CASE WHEN area < 0.05 THEN 'small' WHEN area < 0.2 THEN 'medium' ELSE 'large' END AS size, round(ln(area), 6) AS log_area, round(ln(area / avg(area) OVER (PARTITION BY image)), 6) + 0.0 AS log_scale, CASE WHEN cls = 4 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_foreign
        FROM (SELECT *, {g.area()} AS area FROM {SQL_GT})""",
    "shrink_only": f"""SELECT image, g_idx, p_idx, round({g.iou('g_', 'p_')}, 9) AS iou FROM {_sql_pairs(SQL_GT, sql_pred(1), 'g_', 'p_')} WHERE g_cls = p_cls AND round({g.iou('g_', 'p_')}, 9) >= 0.5 AND round({g.iou('g_', 'p_')}, 9) < 0.85
        AND {_A['x1']} >= {_B['x1']} - 0.02 * g_w AND {_A['y1']} >= {_B['y1']} - 0.02 * g_h AND {_A['x2']} <= {_B['x2']} + 0.02 * g_w AND {_A['y2']} <= {_B['y2']} + 0.02 * g_h""",
    "verdict_exclusion": f"SELECT digest, count(*) AS n_pairs FROM (SELECT {nz.sql_digest('test_sha256')} AS digest, coalesce(upper(trim(decision)), '') AS d FROM test_review) WHERE digest IS NOT NULL GROUP BY digest HAVING count(*) FILTER (d <> 'KEEP') = 0",
    "threshold_grid": f"""WITH q AS (SELECT cls, cut, sum(tp) / count(*) AS p, sum(tp) / any_value(npos) AS r FROM {sql_masked()} JOIN (SELECT cls, count(*) AS npos FROM {SQL_GT} GROUP BY cls) USING (cls), (SELECT CAST(unnest([{', '.join(map(str, CUTS))}]) AS DOUBLE) AS cut) WHERE conf >= cut GROUP BY cls, cut)
        SELECT cls, cut, round(p, 6) AS precision, round(r, 6) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY r DESC, p DESC, cut) AS k FROM q WHERE p >= 0.5) WHERE k = 1""",
    "small_object_recall": f"""WITH s AS (SELECT image, cls FROM {SQL_GT} GROUP BY image, cls HAVING max({g.area()}) < 0.1), h AS (SELECT DISTINCT image, cls FROM {_P0} WHERE conf >= 0.25)
        SELECT s.cls, count(*) AS n_images, round(avg(CASE WHEN h.image IS NULL THEN 0 ELSE 1 END), 6) AS recall FROM s LEFT JOIN h ON h.image = s.image AND h.cls = s.cls GROUP BY s.cls""",
    "head_per_source": f"""SELECT doc_id, source, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM (SELECT doc_id, replace(trim(regexp_replace(lower({nz.sql_known('source')}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ', '_') AS source FROM documents) WHERE source IS NOT NULL) WHERE place <= 3""",
    "top_of_several": f"""WITH p AS MATERIALIZED (SELECT image, idx, conf, {g.area()} AS area, greatest(w / h, h / w) AS aspect FROM {_P0}),
        u AS ({' UNION ALL '.join(f"(SELECT image, idx, '{n}' AS score FROM p ORDER BY round({n}, 9) DESC, image, idx LIMIT 40)" for n in ('conf', 'area', 'aspect'))}) SELECT image, idx, string_agg(score, ',' ORDER BY score) AS scores FROM u GROUP BY image, idx""",
    "item_keys": f"SELECT image, idx, concat_ws(':', image, cls, row_number() OVER (PARTITION BY image, cls ORDER BY idx) - 1) AS item_key FROM {SQL_GT}",
    "precision_at_k": f"SELECT model, round(avg(tp) FILTER (k <= 50), 6) AS p_at_50, round(avg(tp), 6) AS p_at_200 FROM (SELECT * FROM {_sql_top(0)} UNION ALL SELECT * FROM {_sql_top(1)}) WHERE k <= 200 GROUP BY model",
    "override_coalesce": f"""WITH o AS (SELECT manifest_index, max({nz.sql_hash_bits('phash')}) AS own FROM image_sha256 GROUP BY manifest_index), a AS (SELECT rid, arg_max(h, recorded_at) AS audit FROM (SELECT rid, recorded_at, {nz.sql_hash_bits('phash')} AS h FROM audit_records) GROUP BY rid)
        SELECT manifest_index, coalesce(audit, own) AS hash, CASE WHEN audit IS NOT NULL THEN 'audit' WHEN own IS NOT NULL THEN 'image' ELSE 'none' END AS origin FROM o LEFT JOIN a ON a.rid = o.manifest_index""",
    "overlay_names": f"""WITH r AS (SELECT regexp_extract(overlay_image, '([^/\\\\]+)\\.[A-Za-z]+$', 1) AS i, regexp_extract(overlay_label, '([^/\\\\]+)\\.[A-Za-z]+$', 1) AS l, concat_ws('_', {nz.sql_name('source')}, substr({nz.sql_digest('source_sha256')}, 1, 16)) AS wanted, overlay_image FROM (SELECT DISTINCT * FROM direct_overlay_manifest))
        SELECT count(*) AS n, count(*) FILTER (i = wanted) AS n_by_content, count(*) FILTER (i = l) AS n_paired, count(DISTINCT overlay_image) AS n_images FROM r""",
}
