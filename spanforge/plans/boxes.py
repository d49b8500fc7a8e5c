"""Boxes within images: profiles, flags, pair joins, and matching that needs no order of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import geometry as g
from spanforge.functions.geometry import col
from spanforge.sources.fixtures import SQL_GT, TAXONOMY, gt_boxes, pred_boxes, sql_pred
from spanforge.sources.tables import table

IMAGE_SIDE = 640
ANCHOR_MODELS = 4


def prefixed(df: DataFrame, p: str, keep: tuple[str, ...] = ("image",)) -> DataFrame:
    """Columns renamed by a prefix, but for those of the join."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(p + c) for c in df.columns])


def pairs(left: DataFrame, right: DataFrame, a: str, b: str, how: str = "inner", same_class: bool = False) -> DataFrame:
    """Every pair of boxes within an image: an equi-join on the image, never a cross join."""
    l, r = prefixed(left, a), prefixed(right, b)
    joined = l.join(r, "image", how)
    return joined.where(F.col(f"{a}cls") == F.col(f"{b}cls")) if same_class else joined


def _r(text: str, name: str, digits: int = 6) -> Column:
    return F.round(col(text), digits).alias(name)


def _sql_pairs(left: str, right: str, a: str, b: str, kind: str = "JOIN", left_cols: str = "idx cls cx cy w h", right_cols: str = "idx cls cx cy w h conf") -> str:
    lc = ", ".join(f"{c} AS {a}{c}" for c in left_cols.split())
    rc = ", ".join(f"{c} AS {b}{c}" for c in right_cols.split())
    return f"(SELECT image, {lc} FROM {left}) {kind} (SELECT image, {rc} FROM {right}) USING (image)"


def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and boxes per class, 0 where there are none."""
    names = spark.createDataFrame(list(enumerate(TAXONOMY)), "cls int, class string")
    counts = gt_boxes(spark, sf_dir).groupBy("cls").agg(F.countDistinct("image").alias("n_images"), F.count("*").alias("n_boxes"))
    return names.join(counts, "cls", "left").select("class", F.coalesce("n_images", F.lit(0)).alias("n_images"), F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images with a split and a source, from the orders."""
    orders = table(spark, sf_dir, "orders")
    split = F.when(F.col("o_orderkey") % 10 < 8, "train").when(F.col("o_orderkey") % 10 == 8, "val").otherwise("test")
    return orders.select(F.col("o_orderkey").alias("image"), split.alias("split"), F.col("o_orderpriority").alias("source")).distinct()


_SQL_TAGS = "(SELECT DISTINCT o_orderkey AS image, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split, o_orderpriority AS source FROM orders)"


def distribution_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes per split, one column per class."""
    rows = gt_boxes(spark, sf_dir).join(_tags(spark, sf_dir).select("image", "split"), "image")
    wide = rows.groupBy("split").pivot("cls", list(range(6))).count().na.fill(0)
    return wide.select("split", *[F.col(str(i)).alias(f"class_{i}") for i in range(6)])


def distribution_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivot melted again."""
    return distribution_pivot(spark, sf_dir).unpivot("split", [f"class_{i}" for i in range(6)], "class", "n_boxes")


def geometry_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, aspect and edges per class, with exact quantiles."""
    rows = gt_boxes(spark, sf_dir).select("cls", col(g.area()).alias("area"), col("w / h").alias("aspect"), col(g.touches_edge()).alias("edge"))
    return rows.groupBy("cls").agg(
        F.count("*").alias("n_boxes"), F.round(F.percentile("area", 0.5), 6).alias("median_area"), F.round(F.percentile("area", 0.1), 6).alias("p10_area"), F.round(F.percentile("area", 0.9), 6).alias("p90_area"),
        F.round(F.percentile("area", 0.01), 6).alias("p01_area"), F.round(F.percentile("aspect", 0.5), 6).alias("median_aspect"), F.round(F.avg(F.col("edge").cast("int")), 6).alias("edge_rate"),
        F.round(F.stddev_pop("area"), 6).alias("std_area"),
    )


def style_outliers(spark: SparkSession, sf_dir: str, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """Sources whose median area of a class is far from that of the class, from 20 boxes on."""
    rows = gt_boxes(spark, sf_dir).select("image", "cls", col(g.area()).alias("area")).join(_tags(spark, sf_dir).select("image", "source"), "image")
    rows = rows.withColumn("source", F.concat_ws(":", "source", (F.floor(F.col("area") * 3)).cast("int")))
    by_source = rows.groupBy("source", "cls").agg(F.percentile("area", 0.5).alias("m"), F.count("*").alias("n_boxes")).where("n_boxes >= 20")
    by_class = rows.groupBy("cls").agg(F.percentile("area", 0.5).alias("mc"))
    ratio = F.col("m") / F.col("mc")
    return by_source.join(by_class, "cls").where((ratio < low) | (ratio > high)).select("source", "cls", "n_boxes", F.round(ratio, 6).alias("ratio"))


def crosstab_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes per class and size, with margins."""
    rows = gt_boxes(spark, sf_dir).select("cls", col(g.size_bin(size=IMAGE_SIDE)).alias("size"))
    cube = rows.cube("cls", "size").agg(F.count("*").alias("n"), F.grouping("cls").alias("gc"), F.grouping("size").alias("gs"))
    return cube.select(F.when(F.col("gc") == 1, "All").otherwise(F.col("cls").cast("string")).alias("class"), F.when(F.col("gs") == 1, "All").otherwise(F.col("size")).alias("size"), "n")


def scale_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gt_boxes(spark, sf_dir).select("cls", col(g.scale_bin()).alias("scale"), col("greatest(w / h, h / w)").alias("extreme"))
    return rows.groupBy("cls", "scale").agg(F.count("*").alias("n"), F.count_if(F.col("extreme") >= 3).alias("n_long"), F.round(F.max("extreme"), 6).alias("longest"))


def edge_and_tiny_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags per box by two different rules for tiny ones."""
    rows = gt_boxes(spark, sf_dir)
    side = f"least(w, h) * {IMAGE_SIDE} / 10"
    return rows.select(
        "image", "idx", col(g.touches_edge()).alias("edge"), (col(f"{side} < 4") | col(f"{g.area()} < 0.01")).alias("tiny_audit"), col(f"{side} < 4").alias("tiny_rule"), col("greatest(w / h, h / w) >= 4").alias("extreme")
    ).where("edge or tiny_audit or extreme")


def operational_min_side(spark: SparkSession, sf_dir: str, least: float = 60.0) -> DataFrame:
    """Whole images are kept only if no box is too small once the image is scaled."""
    sized = gt_boxes(spark, sf_dir).withColumn("width", (F.col("image") % 5 + 4) * 320).withColumn("height", (F.col("image") % 3 + 3) * 240)
    rows = sized.groupBy("image").agg(F.min(col(g.letterbox_side(size=IMAGE_SIDE))).alias("side"), F.count("*").alias("n_boxes"), F.count_if(col(g.letterbox_side(size=IMAGE_SIDE)) < least).alias("n_tiny"))
    return rows.select("image", F.round(F.coalesce("side", F.lit(9999.0)), 6).alias("side"), "n_boxes", "n_tiny", (F.col("side") >= least).alias("kept"))


def background_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without any box."""
    return _tags(spark, sf_dir).join(gt_boxes(spark, sf_dir).select("image"), "image", "left_anti").select("image", "split")


def coordinate_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes to corners and back, clipped on the way."""
    c = g.corners()
    back = g.clipped(c["x1"], c["y1"], c["x2"], c["y2"])
    return gt_boxes(spark, sf_dir).select("image", "idx", *[_r(v, k) for k, v in c.items()], *[_r(v, f"{k}_back") for k, v in back.items()])


def dup_gt_pairs(spark: SparkSession, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pairs of boxes of one class that lie on each other."""
    gt = gt_boxes(spark, sf_dir)
    rows = pairs(gt, gt, "a_", "b_", same_class=True).where("a_idx < b_idx").withColumn("iou", col(g.iou("a_", "b_")))
    return rows.where(F.col("iou") >= least).select("image", "a_idx", "b_idx", F.col("a_cls").alias("cls"), F.round("iou", 6).alias("iou"))


def overlap_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of classes 1 and 2 that overlap: one of them is wrong."""
    gt = gt_boxes(spark, sf_dir)
    rows = pairs(gt.where("cls = 1"), gt.where("cls = 2"), "a_", "b_")
    return rows.where(col(f"{g.iou('a_', 'b_')} >= 0.1")).select("image", "a_idx", "b_idx", _r(g.iou("a_", "b_"), "iou"), _r(g.ioa("a_", "b_"), "ioa"))


def teacher_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and predictions that disagree: loose_box or missed_gt, wrong_class, missing_label."""
    gt, pred = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir)
    both = pairs(gt, pred, "g_", "p_", "left").withColumn("iou", F.coalesce(col(g.iou("g_", "p_", "add9")), F.lit(0.0)))
    same = F.col("g_cls") == F.col("p_cls")
    per_gt = both.groupBy("image", "g_idx", "g_cls").agg(
        F.max(F.when(same & (F.col("p_conf") >= 0.5), F.col("iou"))).alias("tight"), F.max(F.when(same & (F.col("iou") >= 0.3), F.col("p_conf"))).alias("seen"),
        F.max(F.when(~same & (F.col("p_conf") >= 0.6), F.col("iou"))).alias("other"),
    )
    loose = F.when(F.col("tight").between(0.3, 0.7) & (F.col("tight") < 0.7), "loose_box").when(F.coalesce("seen", F.lit(0.0)) < 0.1, "missed_gt")
    a = per_gt.withColumn("flag", loose).where("flag is not null").select("image", F.col("g_idx").alias("idx"), "flag")
    b = per_gt.where("other >= 0.6").select("image", F.col("g_idx").alias("idx"), F.lit("wrong_class").alias("flag"))
    seen = pairs(pred.where("conf >= 0.6"), gt, "p_", "g_", "left").withColumn("iou", F.coalesce(col(g.iou("g_", "p_", "add9")), F.lit(0.0)))
    c = seen.groupBy("image", "p_idx").agg(F.max("iou").alias("best")).where("best < 0.3").select("image", F.col("p_idx").alias("idx"), F.lit("missing_label").alias("flag"))
    return a.unionByName(b).unionByName(c)


def flip_scores(spark: SparkSession, sf_dir: str, least: float = 0.3, gain: float = 0.1) -> DataFrame:
    """Images whose labels fit the predictions better once mirrored."""
    gt, pred = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir).where("conf >= 0.25")
    turned = F.explode(F.array(*[F.struct(F.lit(i).alias("n"), F.lit(k).alias("transform"), col(x).alias("x"), col(y).alias("y")) for i, (k, (x, y)) in enumerate(g.FLIPS.items())]))
    four = gt.withColumn("t", turned).select("image", "idx", "cls", F.col("t.x").alias("cx"), F.col("t.y").alias("cy"), "w", "h", F.col("t.n").alias("n"), F.col("t.transform").alias("transform"))
    both = prefixed(four, "g_").withColumnRenamed("g_cls", "cls").join(prefixed(pred, "p_").withColumnRenamed("p_cls", "cls"), ["image", "cls"], "left")
    per_gt = both.groupBy("image", "g_idx", "g_n", "g_transform").agg(F.coalesce(F.max(col(g.iou("g_", "p_", "add12"))), F.lit(0.0)).alias("iou"))
    scores = per_gt.groupBy("image", "g_n", "g_transform").agg(F.round(F.avg("iou"), 9).alias("score"), F.count("*").alias("n_gt"))
    best = scores.groupBy("image").agg(F.max_by("g_transform", F.struct("score", -F.col("g_n"))).alias("transform"), F.max("score").alias("score"), F.max(F.when(F.col("g_n") == 0, F.col("score"))).alias("score_none"), F.max("n_gt").alias("n_gt"))
    return best.where(f"transform <> 'none' and score >= {least} and score - score_none >= {gain}").select("image", "transform", "n_gt", F.round("score", 6).alias("score"), F.round("score_none", 6).alias("score_none"))


def consensus_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of an anchor model that the others confirm and no label covers; the mean box."""
    anchor = pred_boxes(spark, sf_dir, 0).where("conf >= 0.2")
    voters = None
    for m in range(1, ANCHOR_MODELS):
        one = pred_boxes(spark, sf_dir, m).where("conf >= 0.2").withColumn("model", F.lit(m))
        voters = one if voters is None else voters.unionByName(one)
    both = pairs(anchor, voters, "a_", "v_", same_class=True).withColumn("iou", F.round(col(g.iou("a_", "v_")), 9)).where("iou >= 0.5")
    best = both.groupBy("image", "a_idx", "v_model").agg(F.max_by(F.struct("v_cx", "v_cy", "v_w", "v_h", "v_conf"), F.struct("iou", -F.col("v_idx"))).alias("v"))
    kept = best.groupBy("image", "a_idx").agg(F.count("*").alias("n"), F.sum("v.v_cx").alias("sx"), F.sum("v.v_cy").alias("sy"), F.sum("v.v_conf").alias("sc")).where("n >= 2")
    full = kept.join(prefixed(anchor, "a_"), ["image", "a_idx"])
    covered = pairs(anchor, gt_boxes(spark, sf_dir), "a_", "g_").where(col(f"{g.iou('a_', 'g_')} >= 0.9")).select("image", "a_idx").distinct()
    return full.join(covered, ["image", "a_idx"], "left_anti").select(
        "image", "a_idx", (F.col("n") + 1).alias("voters"), (F.round((F.col("sx") + F.col("a_cx")) / (F.col("n") + 1), 6) + F.lit(0.0)).alias("cx"), (F.round((F.col("sy") + F.col("a_cy")) / (F.col("n") + 1), 6) + F.lit(0.0)).alias("cy"),
        F.round((F.col("sc") + F.col("a_conf")) / (F.col("n") + 1), 6).alias("conf"),
    )


def mutual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and sure predictions that are each other's best, but not tight: to be refined."""
    both = pairs(gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir).where("conf >= 0.5"), "g_", "p_", same_class=True).withColumn("iou", F.round(col(g.iou("g_", "p_", "add9")), 9))
    best_p = F.row_number().over(Window.partitionBy("image", "g_idx").orderBy(F.desc("iou"), "p_idx"))
    best_g = F.row_number().over(Window.partitionBy("image", "p_idx").orderBy(F.desc("iou"), "g_idx"))
    rows = both.withColumn("kp", best_p).withColumn("kg", best_g).where("kp = 1 and kg = 1 and iou >= 0.5 and iou < 0.75")
    return rows.select("image", "g_idx", "p_idx", F.round("iou", 6).alias("iou"))


def containment_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions around the centre of a label with a fair ratio of areas: proposed, ambiguous or no match."""
    gt, pred = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir, 1)
    ratio = f"({g.area('p_')} / {g.area('g_')})"
    both = pairs(gt, pred, "g_", "p_", "left")
    good = col(f"{g.centre_inside('g_', 'p_')} AND {ratio} >= 0.5 AND {ratio} <= 2 AND g_cls = p_cls")
    score = F.round(col(f"{ratio} - 0.1 * p_conf"), 9)
    rows = both.groupBy("image", "g_idx").agg(F.count_if(good).alias("n"), F.min(F.when(good, F.struct(score.alias("s"), F.col("p_idx").alias("p")))).alias("best"))
    status = F.when(F.col("n") == 1, "proposed").when(F.col("n") > 1, "ambiguous").otherwise("no_match")
    return rows.select("image", "g_idx", status.alias("status"), F.col("best.p").alias("p_idx"), F.round("best.s", 6).alias("score"))


def best_gt_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching without masking: each prediction has its best label; the first by confidence is right, later ones aren't."""
    rows = _matched(spark, sf_dir)
    return rows.groupBy("cls").agg(F.count("*").alias("n_pred"), F.sum("tp").alias("n_tp"))


def _matched(spark: SparkSession, sf_dir: str, threshold: float = 0.5, model: int = 0) -> DataFrame:
    """(image, idx, cls, conf, tp) of every prediction."""
    pred, gt = pred_boxes(spark, sf_dir, model), gt_boxes(spark, sf_dir)
    both = prefixed(pred, "p_").withColumnRenamed("p_cls", "cls").join(prefixed(gt, "g_").withColumnRenamed("g_cls", "cls"), ["image", "cls"], "left")
    score = F.round(col(g.iou("p_", "g_", "add9")), 9)
    best = both.groupBy("image", "p_idx", "cls", "p_conf").agg(F.max(F.struct(score.alias("iou"), (-F.col("g_idx")).alias("g"))).alias("b"))
    first = F.row_number().over(Window.partitionBy("image", "cls", "b.g", F.col("b.iou") >= threshold).orderBy(F.desc("p_conf"), "p_idx"))
    tp = (F.col("b.iou") >= threshold) & (first == 1)
    return best.withColumn("tp", F.coalesce(tp, F.lit(False)).cast("int")).select("image", F.col("p_idx").alias("idx"), "cls", F.col("p_conf").alias("conf"), "tp")


def masked_matches(pred: DataFrame, gt: DataFrame, thresholds: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(image, idx, cls, conf, tp) of every prediction, ``tp`` an array of 0 or 1 per threshold.

    Within an image and class the surest prediction chooses first; a label that is used is masked, and the
    prediction falls to its next best label (ties: the first). The pairs are made once and
    folded for each threshold, as a lower one uses up more labels. Boxes of one image and class are few.
    """
    both = prefixed(pred, "p_").withColumnRenamed("p_cls", "cls").join(prefixed(gt, "g_").withColumnRenamed("g_cls", "cls"), ["image", "cls"], "left")
    score = F.round(col(g.iou("p_", "g_", "add9")), 9)
    near = F.when(score >= min(thresholds), F.struct((-score).alias("s"), F.col("g_idx").alias("g")))
    each = both.groupBy("image", "cls", "p_idx", "p_conf").agg(F.sort_array(F.collect_list(near)).alias("near"))
    rows = each.groupBy("image", "cls").agg(F.sort_array(F.collect_list(F.struct((-F.col("p_conf")).alias("c"), F.col("p_idx").alias("idx"), "near"))).alias("ps"))

    def used(t: float) -> Column:
        """The label of each prediction in turn, or -1."""
        first = lambda s, p: F.get(F.filter(p["near"], lambda x: (-x["s"] >= t) & ~F.array_contains(s, x["g"])), F.lit(0))["g"]
        return F.aggregate("ps", F.array().cast("array<int>"), lambda s, p: F.concat(s, F.array(F.coalesce(first(s, p), F.lit(-1)))))

    rows = rows.select("image", "cls", "ps", *[used(t).alias(f"u{i}") for i, t in enumerate(thresholds)])
    one = rows.select("image", "cls", F.explode(F.arrays_zip("ps", *[f"u{i}" for i in range(len(thresholds))])).alias("r"))
    return one.select("image", F.col("r.ps.idx").alias("idx"), "cls", (-F.col("r.ps.c")).alias("conf"), F.array(*[(F.col(f"r.u{i}") >= 0).cast("int") for i in range(len(thresholds))]).alias("tp"))


def _masked(spark: SparkSession, sf_dir: str, threshold: float = 0.5, model: int = 0) -> DataFrame:
    """Like ``_matched``, but with used labels masked."""
    return masked_matches(pred_boxes(spark, sf_dir, model), gt_boxes(spark, sf_dir), (threshold,)).withColumn("tp", F.col("tp")[0])


def multi_threshold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each of ten thresholds: pairs by IoU, one per prediction, then one per label (its first prediction)."""
    both = pairs(gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir), "g_", "p_", same_class=True).withColumn("iou", F.round(col(g.iou("g_", "p_", "add9")), 9)).where("iou >= 0.5")
    best = both.groupBy("image", "g_cls", "p_idx").agg(F.max(F.struct("iou", (-F.col("g_idx")).alias("g"))).alias("b"))
    steps = F.explode(F.array(*[F.lit(t) for t in range(50, 100, 5)]))
    each = best.select("image", F.col("g_cls").alias("cls"), "p_idx", "b.iou", "b.g", steps.alias("t")).where("iou >= t / 100")
    hit = each.groupBy("image", "cls", "t", "g").agg(F.min("p_idx").alias("p"))
    return hit.groupBy("cls", "t").agg(F.count("*").alias("n_tp")).withColumnRenamed("t", "threshold")


def suspicion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How little the predictions of four models support a label, and how much they disagree."""
    gt = gt_boxes(spark, sf_dir)
    out = None
    for m in range(ANCHOR_MODELS):
        both = pairs(gt, pred_boxes(spark, sf_dir, m), "g_", "p_", "left")
        same = F.col("g_cls") == F.col("p_cls")
        sure = F.max(F.when(same & col(f"{g.iou('g_', 'p_')} >= 0.5"), F.col("p_conf")))
        one = both.groupBy("image", "g_idx").agg(F.coalesce(sure, F.lit(0.0)).alias("conf"), F.coalesce(F.max(F.when(same, col(f"p_conf * {g.iou('g_', 'p_')}"))), F.lit(0.0)).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("image", "g_idx").agg(F.round(1 - F.max("conf"), 6).alias("s_conf"), F.round(1 - F.max("loss"), 9).alias("s_loss"), F.round(F.stddev_pop("conf"), 6).alias("s_disagree"))


QUERIES = {
    f.__name__: f
    for f in (
        class_distribution, distribution_pivot, distribution_long, geometry_profile, style_outliers, crosstab_margins, scale_bins, edge_and_tiny_flags, operational_min_side, background_only,
        coordinate_round_trip, dup_gt_pairs, overlap_conflicts, teacher_flags, flip_scores, consensus_votes, mutual_best, containment_proposals, best_gt_match, multi_threshold_match, suspicion,
    )
}

_P0 = sql_pred(0)
_GP = _sql_pairs(SQL_GT, _P0, "g_", "p_")
_GG = _sql_pairs(SQL_GT, SQL_GT, "a_", "b_", right_cols="idx cls cx cy w h")
_SIDE = f"least(w, h) * {IMAGE_SIDE} / 10"
_CORNERS = g.corners()
_BACK = {k: v.replace("0.0D", "0.0").replace("1.0D", "1.0") for k, v in g.clipped(*[_CORNERS[k] for k in ("x1", "y1", "x2", "y2")]).items()}
_VALUES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(TAXONOMY))


def sql_matched(threshold: float = 0.5, model: int = 0) -> str:
    return f"""(SELECT image, p_idx AS idx, p_cls AS cls, p_conf AS conf, CASE WHEN iou >= {threshold} AND row_number() OVER (PARTITION BY image, p_cls, g_idx, iou >= {threshold} ORDER BY p_conf DESC, p_idx) = 1 THEN 1 ELSE 0 END AS tp
      FROM (SELECT p.*, b.g_idx, b.iou FROM (SELECT image, idx AS p_idx, cls AS p_cls, conf AS p_conf FROM {sql_pred(model)}) p
            LEFT JOIN (SELECT image, p_idx, g_idx, round({g.iou('p_', 'g_', 'add9')}, 9) AS iou, row_number() OVER (PARTITION BY image, p_idx ORDER BY round({g.iou('p_', 'g_', 'add9')}, 9) DESC, g_idx) AS k
                       FROM {_sql_pairs(SQL_GT, sql_pred(model), 'g_', 'p_')} WHERE g_cls = p_cls) b ON b.image = p.image AND b.p_idx = p.p_idx AND b.k = 1))"""


def sql_masked(threshold: float = 0.5, model: int = 0, steps: tuple[float, ...] = ()) -> str:
    """Matching with masking, prediction by prediction: the state of an image, class and threshold is the list of used labels. Columns thr, image, idx, cls, conf, hit (the label), tp."""
    ts = steps or (threshold,)
    return f"""(WITH RECURSIVE pp AS MATERIALIZED (SELECT image, idx, cls, conf, row_number() OVER (PARTITION BY image, cls ORDER BY conf DESC, idx) AS k FROM {sql_pred(model)}),
      nn AS MATERIALIZED (SELECT image, p_idx, list(struct_pack(g := g_idx, s := iou) ORDER BY iou DESC, g_idx) AS near
        FROM (SELECT *, round({g.iou('p_', 'g_', 'add9')}, 9) AS iou FROM {_sql_pairs(SQL_GT, sql_pred(model), 'g_', 'p_')} WHERE g_cls = p_cls) WHERE iou >= {min(ts)} GROUP BY image, p_idx),
      cc AS MATERIALIZED (SELECT pp.*, coalesce(near, []) AS near FROM pp LEFT JOIN nn ON nn.image = pp.image AND nn.p_idx = pp.idx),
      ww(thr, image, cls, k, idx, conf, used, hit) AS (
        SELECT thr, image, cls, CAST(0 AS BIGINT), CAST(-1 AS INTEGER), CAST(0 AS DOUBLE), CAST([] AS INTEGER[]), CAST(NULL AS INTEGER) FROM (SELECT DISTINCT image, cls FROM pp), (SELECT CAST(unnest([{', '.join(map(str, ts))}]) AS DOUBLE) AS thr)
        UNION ALL
        SELECT thr, image, cls, k, idx, conf, CASE WHEN h IS NULL THEN used ELSE list_append(used, h) END, h
        FROM (SELECT w.thr, w.image, w.cls, c.k, c.idx, c.conf, w.used, list_filter(c.near, lambda x: x.s >= w.thr AND NOT list_contains(w.used, x.g))[1].g AS h FROM ww w JOIN cc c ON c.image = w.image AND c.cls = w.cls AND c.k = w.k + 1))
      SELECT thr, image, idx, cls, conf, hit, CASE WHEN hit IS NULL THEN 0 ELSE 1 END AS tp FROM ww WHERE k > 0)"""


_FLIPPED = " UNION ALL ".join(f"SELECT image, idx, cls, {x} AS cx, {y} AS cy, w, h, {i} AS n, '{k}' AS transform FROM gt" for i, (k, (x, y)) in enumerate(g.FLIPS.items()))
_VOTERS = " UNION ALL ".join(f"SELECT *, {m} AS model FROM {sql_pred(m)} WHERE conf >= 0.2" for m in range(1, ANCHOR_MODELS))
_SUSPICION = " UNION ALL ".join(
    f"""SELECT image, g_idx, coalesce(max(CASE WHEN {g.iou('g_', 'p_')} >= 0.5 THEN p_conf END) FILTER (g_cls = p_cls), 0) AS conf, coalesce(max(p_conf * {g.iou('g_', 'p_')}) FILTER (g_cls = p_cls), 0) AS loss
        FROM (SELECT * FROM {_sql_pairs(SQL_GT, sql_pred(m), 'g_', 'p_', 'LEFT JOIN')}) GROUP BY image, g_idx"""
    for m in range(ANCHOR_MODELS)
)
_RATIO = f"({g.area('p_')} / {g.area('g_')})"
_GOOD = f"({g.centre_inside('g_', 'p_')} AND {_RATIO} >= 0.5 AND {_RATIO} <= 2 AND g_cls = p_cls)"

SQL = {
    "class_distribution": f"SELECT t.class, count(DISTINCT image) AS n_images, count(image) AS n_boxes FROM (VALUES {_VALUES}) t(cls, class) LEFT JOIN {SQL_GT} USING (cls) GROUP BY t.class",
    "distribution_pivot": f"SELECT split, {', '.join(f'count(*) FILTER (cls = {i}) AS class_{i}' for i in range(6))} FROM {SQL_GT} JOIN {_SQL_TAGS} USING (image) GROUP BY split",
    "distribution_long": f"SELECT split, class, n_boxes FROM (" + " UNION ALL ".join(f"SELECT split, 'class_{i}' AS class, count(*) FILTER (cls = {i}) AS n_boxes FROM {SQL_GT} JOIN {_SQL_TAGS} USING (image) GROUP BY split" for i in range(6)) + ")",
    "geometry_profile": f"""SELECT cls, count(*) AS n_boxes, round(quantile_cont(area, 0.5), 6) AS median_area, round(quantile_cont(area, 0.1), 6) AS p10_area, round(quantile_cont(area, 0.9), 6) AS p90_area,
        round(quantile_cont(area, 0.01), 6) AS p01_area, round(quantile_cont(aspect, 0.5), 6) AS median_aspect, round(avg(CAST(edge AS INTEGER)), 6) AS edge_rate, round(stddev_pop(area), 6) AS std_area
        FROM (SELECT cls, {g.area()} AS area, w / h AS aspect, {g.touches_edge()} AS edge FROM {SQL_GT}) GROUP BY cls""",
    "style_outliers": f"""WITH r AS MATERIALIZED (SELECT cls, area, source || ':' || CAST(CAST(floor(area * 3) AS INTEGER) AS VARCHAR) AS source FROM (SELECT image, cls, {g.area()} AS area FROM {SQL_GT}) JOIN {_SQL_TAGS} USING (image))
        SELECT source, cls, n_boxes, round(m / mc, 6) AS ratio FROM (SELECT source, cls, quantile_cont(area, 0.5) AS m, count(*) AS n_boxes FROM r GROUP BY source, cls HAVING n_boxes >= 20)
        JOIN (SELECT cls, quantile_cont(area, 0.5) AS mc FROM r GROUP BY cls) USING (cls) WHERE m / mc < 0.5 OR m / mc > 1.5""",
    "crosstab_margins": f"""SELECT CASE WHEN grouping(cls) = 1 THEN 'All' ELSE CAST(cls AS VARCHAR) END AS class, CASE WHEN grouping(size) = 1 THEN 'All' ELSE size END AS size, count(*) AS n
        FROM (SELECT cls, {g.size_bin(size=IMAGE_SIDE)} AS size FROM {SQL_GT}) GROUP BY CUBE (cls, size)""",
    "scale_bins": f"""SELECT cls, scale, count(*) AS n, count(*) FILTER (extreme >= 3) AS n_long, round(max(extreme), 6) AS longest FROM (SELECT cls, {g.scale_bin()} AS scale, greatest(w / h, h / w) AS extreme FROM {SQL_GT}) GROUP BY cls, scale""",
    "edge_and_tiny_flags": f"""SELECT * FROM (SELECT image, idx, {g.touches_edge()} AS edge, {_SIDE} < 4 OR {g.area()} < 0.01 AS tiny_audit, {_SIDE} < 4 AS tiny_rule, greatest(w / h, h / w) >= 4 AS extreme FROM {SQL_GT}) WHERE edge OR tiny_audit OR extreme""",
    "operational_min_side": f"""SELECT image, round(min(side), 6) AS side, count(*) AS n_boxes, count(*) FILTER (side < 60) AS n_tiny, min(side) >= 60 AS kept
        FROM (SELECT image, {g.letterbox_side(size=IMAGE_SIDE)} AS side FROM (SELECT *, (image % 5 + 4) * 320 AS width, (image % 3 + 3) * 240 AS height FROM {SQL_GT})) GROUP BY image""",
    "background_only": f"SELECT image, split FROM {_SQL_TAGS} WHERE image NOT IN (SELECT l_orderkey FROM lineitem)",
    "coordinate_round_trip": f"SELECT image, idx, {', '.join(f'round({v}, 6) AS {k}' for k, v in _CORNERS.items())}, {', '.join(f'round({v}, 6) AS {k}_back' for k, v in _BACK.items())} FROM {SQL_GT}",
    "dup_gt_pairs": f"SELECT image, a_idx, b_idx, a_cls AS cls, round({g.iou('a_', 'b_')}, 6) AS iou FROM {_GG} WHERE a_cls = b_cls AND a_idx < b_idx AND {g.iou('a_', 'b_')} >= 0.5",
    "overlap_conflicts": f"SELECT image, a_idx, b_idx, round({g.iou('a_', 'b_')}, 6) AS iou, round({g.ioa('a_', 'b_')}, 6) AS ioa FROM {_GG} WHERE a_cls = 1 AND b_cls = 2 AND {g.iou('a_', 'b_')} >= 0.1",
    "teacher_flags": f"""WITH p AS MATERIALIZED (SELECT image, g_idx, g_cls, p_idx, p_cls, p_conf, {g.iou('g_', 'p_', 'add9')} AS iou FROM {_GP}),
        l AS MATERIALIZED (SELECT b.image, b.idx AS g_idx, max(iou) FILTER (g_cls = p_cls AND p_conf >= 0.5) AS tight, max(p_conf) FILTER (g_cls = p_cls AND iou >= 0.3) AS seen, max(iou) FILTER (g_cls <> p_cls AND p_conf >= 0.6) AS other
          FROM {SQL_GT} b LEFT JOIN p ON p.image = b.image AND p.g_idx = b.idx GROUP BY b.image, b.idx)
        SELECT image, g_idx AS idx, CASE WHEN tight >= 0.3 AND tight < 0.7 THEN 'loose_box' ELSE 'missed_gt' END AS flag FROM l WHERE (tight >= 0.3 AND tight < 0.7) OR coalesce(seen, 0) < 0.1
        UNION ALL SELECT image, g_idx, 'wrong_class' FROM l WHERE other >= 0.6
        UNION ALL SELECT b.image, b.idx, 'missing_label' FROM {_P0} b LEFT JOIN p ON p.image = b.image AND p.p_idx = b.idx WHERE b.conf >= 0.6 GROUP BY b.image, b.idx HAVING coalesce(max(iou), 0) < 0.3""",
    "flip_scores": f"""WITH gt AS MATERIALIZED (SELECT * FROM {SQL_GT}), four AS ({_FLIPPED}), pr AS MATERIALIZED (SELECT * FROM {_P0} WHERE conf >= 0.25),
        per AS (SELECT f.image, f.g_idx, f.n, f.transform, coalesce(max({g.iou('g_', 'p_', 'add12')}), 0) AS iou
          FROM (SELECT image, idx AS g_idx, cls, cx AS g_cx, cy AS g_cy, w AS g_w, h AS g_h, n, transform FROM four) f LEFT JOIN (SELECT image, cls, cx AS p_cx, cy AS p_cy, w AS p_w, h AS p_h FROM pr) p ON p.image = f.image AND p.cls = f.cls GROUP BY ALL),
        s AS (SELECT image, n, transform, round(avg(iou), 9) AS score, count(*) AS n_gt FROM per GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, n) AS k, max(score) FILTER (n = 0) OVER (PARTITION BY image) AS score_none FROM s)
        SELECT image, transform, n_gt, round(score, 6) AS score, round(score_none, 6) AS score_none FROM k WHERE k = 1 AND transform <> 'none' AND score >= 0.3 AND score - score_none >= 0.1""",
    "consensus_votes": f"""WITH a AS MATERIALIZED (SELECT * FROM {_P0} WHERE conf >= 0.2), v AS MATERIALIZED ({_VOTERS}),
        c AS (SELECT *, round({g.iou('a_', 'v_')}, 9) AS iou FROM {_sql_pairs('a', 'v', 'a_', 'v_', left_cols='idx cls cx cy w h conf', right_cols='idx cls cx cy w h conf model')} WHERE a_cls = v_cls),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image, a_idx, v_model ORDER BY iou DESC, v_idx) AS k FROM c WHERE iou >= 0.5) WHERE k = 1)
        SELECT image, a_idx, count(*) + 1 AS voters, round((sum(v_cx) + any_value(a_cx)) / (count(*) + 1), 6) + 0.0 AS cx, round((sum(v_cy) + any_value(a_cy)) / (count(*) + 1), 6) + 0.0 AS cy, round((sum(v_conf) + any_value(a_conf)) / (count(*) + 1), 6) AS conf
        FROM b WHERE (image, a_idx) NOT IN (SELECT (image, a_idx) FROM {_sql_pairs('a', SQL_GT, 'a_', 'g_', right_cols='idx cls cx cy w h')} WHERE {g.iou('a_', 'g_')} >= 0.9) GROUP BY image, a_idx HAVING count(*) >= 2""",
    "mutual_best": f"""SELECT image, g_idx, p_idx, round(iou, 6) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY image, g_idx ORDER BY iou DESC, p_idx) AS kp, row_number() OVER (PARTITION BY image, p_idx ORDER BY iou DESC, g_idx) AS kg
        FROM (SELECT *, round({g.iou('g_', 'p_', 'add9')}, 9) AS iou FROM {_GP} WHERE g_cls = p_cls AND p_conf >= 0.5)) WHERE kp = 1 AND kg = 1 AND iou >= 0.5 AND iou < 0.75""",
    "containment_proposals": f"""SELECT image, g_idx, CASE WHEN n = 1 THEN 'proposed' WHEN n > 1 THEN 'ambiguous' ELSE 'no_match' END AS status, p_idx, round(s, 6) AS score
        FROM (SELECT image, g_idx, count(*) FILTER ({_GOOD}) AS n, arg_min(p_idx, (round({_RATIO} - 0.1 * p_conf, 9), p_idx)) FILTER ({_GOOD}) AS p_idx, min(round({_RATIO} - 0.1 * p_conf, 9)) FILTER ({_GOOD}) AS s
              FROM (SELECT * FROM {_sql_pairs(SQL_GT, sql_pred(1), 'g_', 'p_', 'LEFT JOIN')}) GROUP BY image, g_idx)""",
    "best_gt_match": f"SELECT cls, count(*) AS n_pred, sum(tp) AS n_tp FROM {sql_matched()} GROUP BY cls",
    "multi_threshold_match": f"""WITH b AS (SELECT image, g_cls AS cls, p_idx, g_idx, iou FROM (SELECT *, row_number() OVER (PARTITION BY image, p_idx ORDER BY iou DESC, g_idx) AS k FROM (SELECT *, round({g.iou('g_', 'p_', 'add9')}, 9) AS iou FROM {_GP} WHERE g_cls = p_cls)) WHERE k = 1)
        SELECT cls, t AS threshold, count(DISTINCT (image, g_idx)) AS n_tp FROM b, (SELECT CAST(unnest(range(50, 100, 5)) AS INTEGER) AS t) WHERE iou >= t / 100 GROUP BY cls, t""",
    "suspicion": f"SELECT image, g_idx, round(1 - max(conf), 6) AS s_conf, round(1 - max(loss), 9) AS s_loss, round(stddev_pop(conf), 6) AS s_disagree FROM ({_SUSPICION}) GROUP BY image, g_idx",
}
