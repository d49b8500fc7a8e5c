"""Gates as frames of violations, reports, review joins and the assembly of training sets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import geometry as g
from spanforge.functions import normalize as nz
from spanforge.functions.geometry import col
from spanforge.plans.boxes import _SQL_TAGS, _sql_pairs, _tags, pairs
from spanforge.sources.fixtures import SQL_GT, SQL_MANIFEST, TAXONOMY, gt_boxes, manifest, pred_boxes, sql_pred
from spanforge.sources.tables import table

#: The decisions of a review.
DECISIONS = ("keep", "drop")

_SCALE = "CASE WHEN g_w * g_h < 0.05 THEN 'small' WHEN g_w * g_h < 0.2 THEN 'medium' ELSE 'large' END"


def _one(what: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.lit(what).alias("gate"), F.count("*").alias("n"))


def split_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule of the splits is broken: a digest of test in training, a record that names the split `test` for training,
    digests in several splits, synthetic images (dataset of the last two letters) outside train, images without a size, classes with too few boxes."""
    rows = manifest(spark, sf_dir).where("digest is not null")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'").select("digest").distinct()
    shared = rows.where("split is not null").groupBy("digest").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    support = gt_boxes(spark, sf_dir).groupBy("cls").agg(F.countDistinct("image").alias("n")).where("n < 50")
    parts = {
        "test_digest_in_train": train.join(test, "digest", "left_semi"), "test_refused": rows.where("split = 'test'"), "digest_in_several_splits": shared,
        "synthetic_outside_train": rows.where("dataset >= 'w' and coalesce(split, '') <> 'train'"), "no_size": rows.where("width <= 0 or height <= 0"), "class_support": support,
    }
    return reduce(DataFrame.unionByName, [_one(k, v) for k, v in parts.items()])


def frozen_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frozen validation set is the same set and has as many rows: what the image list has more or less than the audit, by digest."""
    side = lambda df, split, digest: df.where(split == "val").select(digest.alias("digest")).where("digest is not null")
    now = side(table(spark, sf_dir, "image_sha256").distinct(), nz.plain_split(F.col("split")), nz.plain_digest(F.col("sha256"))).groupBy("digest").agg(F.count("*").alias("n_now"))
    old = side(table(spark, sf_dir, "audit_records").distinct(), nz.plain_split(F.col("old_split")), nz.plain_digest(F.col("sha256"))).groupBy("digest").agg(F.count("*").alias("n_old"))
    both = now.join(old, "digest", "full")
    status = F.when(F.col("n_old").isNull(), "added").when(F.col("n_now").isNull(), "removed").when(F.col("n_now") != F.col("n_old"), "count_differs").otherwise("same")
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def taxonomy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of two class lists where they differ; the second has two names exchanged and one more."""
    other = [*TAXONOMY[:2], TAXONOMY[3], TAXONOMY[2], *TAXONOMY[4:], "person"]
    a, b = (spark.createDataFrame(list(enumerate(x)), f"place int, {n} string") for x, n in ((TAXONOMY, "ours"), (other, "theirs")))
    return a.join(b, "place", "full").where(~F.col("ours").eqNullSafe(F.col("theirs")))


def parent_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conflicts of an overlay with its parent list, one row each: an unknown dataset, a count that isn't the number of classes named, a digest the parent has in an evaluation split, a target that isn't allowed."""
    rows = table(spark, sf_dir, "direct_overlay_manifest").distinct().select("overlay_id", nz.plain_name(F.col("source")).alias("dataset"), nz.plain_digest(F.col("source_sha256")).alias("digest"), "target_split", "n_mapped_boxes")
    known = table(spark, sf_dir, "source_registry").select(F.col("dataset"), F.lit(True).alias("known"))
    held = manifest(spark, sf_dir).where("split <> 'train' and digest is not null").select("digest", F.lit(True).alias("held")).distinct()
    joined = rows.join(F.broadcast(known), "dataset", "left")  # the registry has a fixed size
    with_digest = joined.where("digest is not null").join(held, "digest", "left").unionByName(joined.where("digest is null").withColumn("held", F.lit(None).cast("boolean")))
    rules = {"unknown_dataset": F.col("known").isNull(), "no_boxes": F.coalesce(F.col("n_mapped_boxes"), F.lit(0)) <= 0, "held_out": F.coalesce("held", F.lit(False)), "bad_target": ~F.coalesce("target_split", F.lit("")).isin("train", "external_eval")}
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return with_digest.select("overlay_id", F.explode(found).alias("conflict"))


def distribution_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes per class and split against a report (the counts of model 0): every count that differs."""
    tags = _tags(spark, sf_dir).select("image", "split")
    count = lambda df, n: df.join(tags, "image").groupBy("split", "cls").agg(F.count("*").alias(n))
    both = count(gt_boxes(spark, sf_dir), "found").join(count(pred_boxes(spark, sf_dir), "reported"), ["split", "cls"], "full").na.fill(0, ["found", "reported"])
    return both.where("found <> reported").select("split", "cls", "found", "reported")


def decision_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that aren't known words are errors, not blanks: how often each is written. Blank ones are open."""
    word = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    kind = F.when(word == "", "open").when(word.isin(*DECISIONS), "known").otherwise("error")
    return table(spark, sf_dir, "test_review").groupBy(word.alias("word"), kind.alias("kind")).agg(F.count("*").alias("n"))


def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of allowed classes (in any case) from a confidence on; a missing confidence passes."""
    names = F.element_at(F.array(*[F.lit(n.upper()) for n in TAXONOMY]), F.col("cls") + 1)
    rows = pred_boxes(spark, sf_dir).withColumn("conf", F.when(F.col("image") % 10 != 0, F.col("conf"))).withColumn("name", names)
    kept = rows.where(F.lower("name").isin("bird_nest", "broken_strand") & F.coalesce(F.col("conf") >= 0.7, F.lit(True)))
    return kept.groupBy(F.lower("name").alias("class")).agg(F.count("*").alias("n"), F.count_if(F.col("conf").isNull()).alias("n_without"))


def tile_edge_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that touch an edge of the tile, or are too small, are rejected; and masks whose share isn't plausible."""
    rows = gt_boxes(spark, sf_dir).select("image", "idx", col(g.touches_edge()).alias("edge"), (col(g.area()) < 0.02).alias("small"), (~col("w * h / 0.8 between 0.1 and 0.9")).alias("mask"))
    return rows.where("edge or small or mask").groupBy("edge", "small", "mask").agg(F.count("*").alias("n"))


def candidate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of the list with at least one box of class 3, and how many."""
    return gt_boxes(spark, sf_dir).where("cls = 3").groupBy("image").agg(F.count("*").alias("n_boxes")).join(_tags(spark, sf_dir).select("image", "split").distinct(), "image")


def background_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images without classes 4 and 5 that have an insulator of middling width."""
    gt = gt_boxes(spark, sf_dir)
    picked = gt.where("cls = 0 and w between 0.2 and 0.5").select("image").distinct()
    return picked.join(gt.where("cls in (4, 5)").select("image").distinct(), "image", "left_anti")


def label_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the labels (the second: sure boxes of model 3): boxes kept, changed, removed and added, by mutual best overlap within the class."""
    old, new = gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir, 3).where("conf >= 0.3")
    both = pairs(old, new, "o_", "n_", same_class=True).withColumn("iou", F.round(col(g.iou("o_", "n_")), 9)).where("iou >= 0.5")
    a = F.row_number().over(Window.partitionBy("image", "o_idx").orderBy(F.desc("iou"), "n_idx"))
    b = F.row_number().over(Window.partitionBy("image", "n_idx").orderBy(F.desc("iou"), "o_idx"))
    met = both.withColumn("a", a).withColumn("b", b).where("a = 1 and b = 1").select("image", "o_idx", "n_idx", F.when(F.col("iou") >= 0.75, "kept").otherwise("box_changed").alias("change"))
    left = old.select("image", F.col("idx").alias("o_idx")).join(met.select("image", "o_idx", "change"), ["image", "o_idx"], "left").select(F.coalesce("change", F.lit("removed")).alias("change"))
    added = new.select("image", F.col("idx").alias("n_idx")).join(met, ["image", "n_idx"], "left_anti").select(F.lit("added").alias("change"))
    return left.unionByName(added).groupBy("change").agg(F.count("*").alias("n"))


def reviewed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions joined to review items by key, with the fields that must agree checked: accepted, rejected, unsure, unknown_key, metadata_differs, box_differs."""
    items = gt_boxes(spark, sf_dir).where("cls = 3").select("image", "idx", "cx", "w")
    made = pred_boxes(spark, sf_dir, 0).where("idx % 2 = 0").select("image", "idx", F.col("cls").alias("d_cls"), (F.col("cx") + F.when(F.col("image") % 19 == 0, 0.001).otherwise(0.0)).alias("d_cx"), "conf")
    own = gt_boxes(spark, sf_dir).select("image", "idx", F.col("cx").alias("seen_cx"))
    made = made.join(own, ["image", "idx"]).withColumn("d_cx", F.col("seen_cx") + F.when(F.col("image") % 19 == 0, 0.001).otherwise(0.0)).where("d_cls in (3, 4)")
    both = made.join(items, ["image", "idx"], "left")
    status = (
        F.when(F.col("cx").isNull(), "unknown_key").when(F.col("d_cls") != 3, "metadata_differs").when(F.abs(F.col("cx") - F.col("d_cx")) > 1e-4, "box_differs")
        .when(F.col("conf") >= 0.6, "accepted").when(F.col("conf") < 0.3, "rejected").otherwise("unsure")
    )
    return both.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def blind_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited label files: ok, fixed or drop; an ok whose labels have changed, or a fix that changed nothing, is an error."""
    text = lambda df, n: df.groupBy("image").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.format_string("%d %.6f", "cls", "cx"))), "\n"), 256).alias(n))
    gt = gt_boxes(spark, sf_dir)
    before, after = text(gt, "before"), text(gt.withColumn("cls", F.when(F.col("image") % 11 == 0, 0).otherwise(F.col("cls"))), "after")
    status = F.element_at(F.array(*[F.lit(x) for x in ("ok", "fixed", "drop")]), (F.col("image") % 3 + 1).cast("int"))
    same = F.col("before") == F.col("after")
    verdict = F.when((F.col("status") == "ok") & ~same, "ok_but_changed").when((F.col("status") == "fixed") & same, "fixed_but_same").otherwise("consistent")
    return before.join(after, "image").withColumn("status", status).groupBy("status", verdict.alias("verdict")).agg(F.count("*").alias("n"))


def review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to review per image: proposed additions and conflicts of classes, in order, with the number of boxes around them."""
    gt = gt_boxes(spark, sf_dir)
    add = pred_boxes(spark, sf_dir, 1).where("cls = 3 and conf >= 0.9").select("image", F.lit("addition").alias("kind"), "idx")
    conflict = gt.where("cls = 2").select("image", F.lit("conflict").alias("kind"), "idx")
    items = add.unionByName(conflict).groupBy("image").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "idx"))), ",").alias("items"), F.count("*").alias("n_items"))
    return items.join(gt.groupBy("image").agg(F.count("*").alias("n_context")), "image")


def progress_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of an audit (class, selection, rank) with the notes made so far; blank where there is none."""
    k = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("conf"), "image", "idx"))
    listed = pred_boxes(spark, sf_dir).withColumn("rank", k).where("rank <= 40").select("cls", F.when(F.col("rank") % 2 == 0, "control").otherwise("error").alias("selection"), "rank")
    notes = listed.where("rank % 3 = 0").select("cls", "selection", "rank", F.concat_ws("-", F.lit("note"), "rank").alias("note"))
    return listed.join(notes, ["cls", "selection", "rank"], "left").select("cls", "selection", "rank", F.coalesce("note", F.lit("")).alias("note"))


def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of labels whose best prediction of the class reaches IoU 0.5, 0.75 and 0.9, by class and size."""
    both = pairs(gt_boxes(spark, sf_dir), pred_boxes(spark, sf_dir), "g_", "p_", "left")
    best = both.groupBy("image", "g_idx", "g_cls", col(_SCALE).alias("scale"))
    best = best.agg(F.coalesce(F.round(F.max(F.when(F.col("g_cls") == F.col("p_cls"), col(g.iou("g_", "p_")))), 9), F.lit(0.0)).alias("iou"))
    return best.groupBy(F.col("g_cls").alias("cls"), "scale").agg(F.count("*").alias("n"), *[F.round(F.avg((F.col("iou") >= t / 100).cast("int")), 6).alias(f"pass_{t}") for t in (50, 75, 90)])


def any_hit_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of proposals where any overlap of 0.5 counts, not one to one: recall uses the same hits."""
    proposals, gt = pred_boxes(spark, sf_dir, 2).where("conf >= 0.5"), gt_boxes(spark, sf_dir)
    best = pairs(proposals, gt, "p_", "g_", "left").groupBy("image", "p_idx").agg(F.coalesce(F.max(col(g.iou("p_", "g_"))), F.lit(0.0)).alias("iou"))
    hits = best.agg(F.count_if(F.col("iou") >= 0.5).alias("tp"), F.count("*").alias("n"))
    return hits.crossJoin(F.broadcast(gt.agg(F.count("*").alias("npos")))).select("tp", F.round(F.col("tp") / F.col("n"), 6).alias("precision"), F.round(F.col("tp") / F.col("npos"), 6).alias("recall"))  # one row each


def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs named dataset_model (split at the first underscore), their long metrics as a wide row: raw beside curated, with the difference."""
    orders = table(spark, sf_dir, "orders")
    key = F.concat_ws("_", F.when(F.col("o_orderkey") % 2 == 0, "raw").otherwise("curated"), F.regexp_replace(F.lower("o_orderpriority"), "[^a-z0-9]+", "_"))
    runs = orders.groupBy(key.alias("run_key")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("value"))
    parts = F.split("run_key", "_", 2)
    wide = runs.select(parts[0].alias("data"), parts[1].alias("model"), "value").groupBy("model").pivot("data", ["raw", "curated"]).agg(F.max("value"))
    return wide.select("model", F.round("raw", 4).alias("raw"), F.round("curated", 4).alias("curated"), F.round(F.col("curated") - F.col("raw"), 4).alias("delta"))


def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A training set from three origins: the parent's train and val records, overlays whose file is kept, and synthetic ones; per origin and split the rows, and those that the gates refuse."""
    parent = manifest(spark, sf_dir).where("split in ('train', 'val')").select("digest", "split", F.lit("parent").alias("origin"))
    overlay = table(spark, sf_dir, "direct_overlay_manifest").distinct().where("n_mapped_boxes > 0").select(nz.plain_digest(F.col("source_sha256")).alias("digest"), F.lit("train").alias("split"), F.lit("overlay").alias("origin"))
    synthetic = manifest(spark, sf_dir).where("split = 'external_eval' and width >= 4000").select("digest", F.lit("train").alias("split"), F.lit("synthetic").alias("origin"))
    rows = parent.unionByName(overlay).unionByName(synthetic)
    test = manifest(spark, sf_dir).where("split = 'test' and digest is not null").select("digest", F.lit(True).alias("in_test")).distinct()
    known = rows.where("digest is not null").join(test, "digest", "left").unionByName(rows.where("digest is null").withColumn("in_test", F.lit(None).cast("boolean")))
    return known.groupBy("origin", "split").agg(F.count("*").alias("n"), F.count_if(F.col("in_test")).alias("n_in_test"), F.count_if(F.col("digest").isNull()).alias("n_without_digest"))


def pair_packaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kept overlay must lead to one image and one label of the same stem: members found, missing and ambiguous."""
    stem = lambda c: F.regexp_extract(c, r"([^/\\]+)\.[A-Za-z]+$", 1)
    rows = table(spark, sf_dir, "direct_overlay_manifest").distinct()
    images = rows.select(stem("overlay_image").alias("stem")).groupBy("stem").agg(F.count("*").alias("n_images"))
    labels = rows.select(stem("overlay_label").alias("stem")).groupBy("stem").agg(F.count("*").alias("n_labels"))
    status = F.when(F.col("n_images").isNull() | F.col("n_labels").isNull(), "missing").when((F.col("n_images") > 1) | (F.col("n_labels") > 1), "ambiguous").otherwise("pair")
    return images.join(labels, "stem", "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def label_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label path of each image path (the last `images` folder becomes `labels`), and image files per split and kind."""
    path = F.translate("image", "\\", "/")
    label = F.regexp_replace(F.regexp_replace(path, r"(^|.*/)images/", "$1labels/"), r"\.[A-Za-z0-9]+$", ".txt")
    rows = table(spark, sf_dir, "image_sha256").select("manifest_index", label.alias("label"), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).alias("kind")).distinct()
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"), F.min("label").alias("first_label"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the anchor class with their place among them, from the list of boxes of each image."""
    lists = gt_boxes(spark, sf_dir).where("cls = 3").groupBy("image").agg(F.array_sort(F.collect_list(F.struct("idx", "cx", "cy"))).alias("b"))
    return lists.select("image", F.posexplode("b").alias("place", "b")).select("image", "place", "b.idx", F.round("b.cx", 6).alias("cx"), F.round("b.cy", 6).alias("cy"))


def provenance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per dataset with its tags and counts, as JSON; required fields are checked by the reader."""
    rows = manifest(spark, sf_dir).where("dataset is not null").groupBy("dataset").agg(F.count("*").alias("n_images"), F.countDistinct("digest").alias("n_digests"), F.min("path").alias("first_path"))
    return rows.select("dataset", F.to_json(F.struct("dataset", F.struct("n_images", "n_digests").alias("counts"), "first_path")).alias("document"))


def tag_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per clerk group the run to go on with: the explicit one, else the only complete one, else the only candidate; several are an error."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("part"), "o_orderkey", (F.col("o_orderkey") % 997 == 0).alias("explicit"), (F.col("o_orderkey") % 151 == 0).alias("complete"))
    agg = rows.groupBy("part").agg(*[F.count_if(c).alias(f"n_{n}") for n, c in (("explicit", F.col("explicit")), ("complete", F.col("complete")), ("all", F.lit(True)))], F.min(F.when(F.col("explicit"), F.col("o_orderkey"))).alias("e"), F.min(F.when(F.col("complete"), F.col("o_orderkey"))).alias("c"), F.min("o_orderkey").alias("a"))
    chosen = F.when(F.col("n_explicit") == 1, F.col("e")).when((F.col("n_explicit") == 0) & (F.col("n_complete") == 1), F.col("c")).when((F.col("n_explicit") + F.col("n_complete") == 0) & (F.col("n_all") == 1), F.col("a"))
    return agg.select("part", chosen.alias("o_orderkey"), F.when(chosen.isNull(), "error").otherwise("chosen").alias("status"))


def stale_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten states per key, the latest first; progress is carried on only where the configuration is the latest one."""
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", k.alias("k"), F.first("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))).alias("latest"))
    return rows.where("k <= 10").select("o_custkey", "k", "o_orderkey", (F.col("o_orderpriority") == F.col("latest")).alias("carried"))


def quota_selection(spark: SparkSession, sf_dir: str, target: int = 600, least: int = 80, soft: float = 0.45) -> DataFrame:
    """A stress set of ``target`` images by score (number of boxes and small ones): first ``least`` of each class, then by score while no class holds more than the share ``soft``.

    Only the first ``target`` images of each class in order of score can be chosen; these few are taken one by one.
    """
    gt = gt_boxes(spark, sf_dir)
    scores = gt.groupBy("image").agg((F.count("*") + F.count_if(col(f"{g.area()} < 0.1"))).alias("score"), F.max("cls").alias("cls"))
    k = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("score"), "image"))
    listed = scores.withColumn("k", k).where(F.col("k") <= target).orderBy(F.desc("score"), "image").collect()
    first = {r["image"] for r in listed if r["k"] <= least}
    held: dict[int, int] = {}
    chosen = []
    for r in [r for r in listed if r["image"] in first] + [r for r in listed if r["image"] not in first]:
        quota = r["image"] in first
        if len(chosen) < target and (quota or held.get(r["cls"], 0) < soft * target):
            held[r["cls"]] = held.get(r["cls"], 0) + 1
            chosen.append((r["image"], r["cls"], r["score"], "quota" if quota else "score"))
    return spark.createDataFrame(chosen, "image bigint, cls int, score bigint, reason string")


QUERIES: dict[str, Callable] = {
    f.__name__: f
    for f in (
        split_gates, frozen_validation, taxonomy_gate, parent_conflicts, distribution_gate, decision_errors, confidence_floor, tile_edge_rejects, candidate_scan, background_picks, label_versions, reviewed_items,
        blind_audit, review_list, progress_merge, pass_rates, any_hit_benchmark, run_report, training_set, pair_packaging, label_paths, anchors, provenance_index, tag_choice, stale_history, quota_selection,
    )
}

_OVL = "(SELECT DISTINCT * FROM direct_overlay_manifest)"
_STEM = "regexp_extract({}, '([^/\\\\]+)\\.[A-Za-z]+$', 1)"
_NAMES = ", ".join(f"({i}, '{n}')" for i, n in enumerate(TAXONOMY))
_LABEL = "regexp_replace(regexp_replace(replace(image, '\\', '/'), '(^|.*/)images/', '\\1labels/'), '\\.[A-Za-z0-9]+$', '.txt')"


def _text_digest(cls: str) -> str:
    return f"(SELECT image, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM (SELECT image, printf('%d %.6f', {cls}, cx) AS line FROM {SQL_GT}) GROUP BY image)"


SQL = {
    "split_gates": f"""WITH m AS MATERIALIZED (SELECT * FROM {SQL_MANIFEST} WHERE digest IS NOT NULL)
        SELECT 'test_digest_in_train' AS gate, count(*) AS n FROM m WHERE split = 'train' AND digest IN (SELECT digest FROM m WHERE split = 'test') UNION ALL SELECT 'test_refused', count(*) FROM m WHERE split = 'test'
        UNION ALL SELECT 'digest_in_several_splits', count(*) FROM (SELECT digest FROM m GROUP BY digest HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'synthetic_outside_train', count(*) FROM m WHERE dataset >= 'w' AND coalesce(split, '') <> 'train'
        UNION ALL SELECT 'no_size', count(*) FROM m WHERE width <= 0 OR height <= 0 UNION ALL SELECT 'class_support', count(*) FROM (SELECT cls FROM {SQL_GT} GROUP BY cls HAVING count(DISTINCT image) < 50)""",
    "frozen_validation": f"""WITH a AS (SELECT d, count(*) AS n FROM (SELECT {nz.sql_split('split')} AS s, {nz.sql_digest('sha256')} AS d FROM (SELECT DISTINCT * FROM image_sha256)) WHERE s = 'val' AND d IS NOT NULL GROUP BY d),
        b AS (SELECT d, count(*) AS n FROM (SELECT {nz.sql_split('old_split')} AS s, {nz.sql_digest('sha256')} AS d FROM (SELECT DISTINCT * FROM audit_records)) WHERE s = 'val' AND d IS NOT NULL GROUP BY d)
        SELECT CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' WHEN a.n <> b.n THEN 'count_differs' ELSE 'same' END AS status, count(*) AS n FROM a FULL JOIN b ON a.d = b.d GROUP BY 1""",
    "taxonomy_gate": f"SELECT * FROM (VALUES (2, '{TAXONOMY[2]}', '{TAXONOMY[3]}'), (3, '{TAXONOMY[3]}', '{TAXONOMY[2]}'), (6, NULL, 'person')) t(place, ours, theirs)",
    "parent_conflicts": f"""WITH o AS (SELECT overlay_id, {nz.sql_name('source')} AS dataset, {nz.sql_digest('source_sha256')} AS digest, target_split, n_mapped_boxes FROM {_OVL}), h AS (SELECT DISTINCT digest FROM {SQL_MANIFEST} WHERE split <> 'train' AND digest IS NOT NULL)
        SELECT overlay_id, 'unknown_dataset' AS conflict FROM o WHERE dataset IS NULL OR dataset NOT IN (SELECT dataset FROM source_registry) UNION ALL SELECT overlay_id, 'no_boxes' FROM o WHERE coalesce(n_mapped_boxes, 0) <= 0
        UNION ALL SELECT overlay_id, 'held_out' FROM o WHERE digest IN (SELECT digest FROM h) UNION ALL SELECT overlay_id, 'bad_target' FROM o WHERE coalesce(target_split, '') NOT IN ('train', 'external_eval')""",
    "distribution_gate": f"""WITH t AS (SELECT image, split FROM {_SQL_TAGS}), a AS (SELECT split, cls, count(*) AS n FROM {SQL_GT} JOIN t USING (image) GROUP BY split, cls), b AS (SELECT split, cls, count(*) AS n FROM {sql_pred(0)} JOIN t USING (image) GROUP BY split, cls)
        SELECT split, cls, coalesce(a.n, 0) AS found, coalesce(b.n, 0) AS reported FROM a FULL JOIN b USING (split, cls) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    "decision_errors": "SELECT word, CASE WHEN word = '' THEN 'open' WHEN word IN ('keep', 'drop') THEN 'known' ELSE 'error' END AS kind, count(*) AS n FROM (SELECT lower(trim(coalesce(decision, ''))) AS word FROM test_review) GROUP BY word",
    "confidence_floor": f"""SELECT class, count(*) AS n, count(*) FILTER (c IS NULL) AS n_without FROM (SELECT class, CASE WHEN image % 10 <> 0 THEN conf END AS c FROM {sql_pred(0)} JOIN (VALUES {_NAMES}) t(cls, class) USING (cls)) WHERE class IN ('bird_nest', 'broken_strand') AND (c >= 0.7 OR c IS NULL) GROUP BY class""",
    "tile_edge_rejects": f"SELECT edge, small, mask, count(*) AS n FROM (SELECT {g.touches_edge()} AS edge, {g.area()} < 0.02 AS small, NOT (w * h / 0.8 BETWEEN 0.1 AND 0.9) AS mask FROM {SQL_GT}) WHERE edge OR small OR mask GROUP BY ALL",
    "candidate_scan": f"SELECT image, n_boxes, split FROM (SELECT image, count(*) AS n_boxes FROM {SQL_GT} WHERE cls = 3 GROUP BY image) JOIN (SELECT DISTINCT image, split FROM {_SQL_TAGS}) USING (image)",
    "background_picks": f"SELECT DISTINCT image FROM {SQL_GT} WHERE cls = 0 AND w BETWEEN 0.2 AND 0.5 AND image NOT IN (SELECT image FROM {SQL_GT} WHERE cls IN (4, 5))",
    "label_versions": f"""WITH n AS MATERIALIZED (SELECT * FROM {sql_pred(3)} WHERE conf >= 0.3), p AS (SELECT *, round({g.iou('o_', 'n_')}, 9) AS iou FROM {_sql_pairs(SQL_GT, 'n', 'o_', 'n_')} WHERE o_cls = n_cls),
        k AS (SELECT *, row_number() OVER (PARTITION BY image, o_idx ORDER BY iou DESC, n_idx) AS a, row_number() OVER (PARTITION BY image, n_idx ORDER BY iou DESC, o_idx) AS b FROM p WHERE iou >= 0.5), m AS MATERIALIZED (SELECT * FROM k WHERE a = 1 AND b = 1)
        SELECT change, count(*) AS n FROM (SELECT CASE WHEN m.iou IS NULL THEN 'removed' WHEN m.iou >= 0.75 THEN 'kept' ELSE 'box_changed' END AS change FROM {SQL_GT} g LEFT JOIN m ON m.image = g.image AND m.o_idx = g.idx
        UNION ALL SELECT 'added' FROM n WHERE (image, idx) NOT IN (SELECT (image, n_idx) FROM m)) GROUP BY change""",
    "reviewed_items": f"""SELECT CASE WHEN i.cls <> 3 THEN 'unknown_key' WHEN d.cls <> 3 THEN 'metadata_differs' WHEN d.image % 19 = 0 THEN 'box_differs' WHEN conf >= 0.6 THEN 'accepted' WHEN conf < 0.3 THEN 'rejected' ELSE 'unsure' END AS status, count(*) AS n
        FROM {sql_pred(0)} d JOIN {SQL_GT} i ON i.image = d.image AND i.idx = d.idx WHERE d.idx % 2 = 0 AND d.cls IN (3, 4) GROUP BY 1""",
    "blind_audit": f"""SELECT status, CASE WHEN status = 'ok' AND NOT same THEN 'ok_but_changed' WHEN status = 'fixed' AND same THEN 'fixed_but_same' ELSE 'consistent' END AS verdict, count(*) AS n
        FROM (SELECT ['ok', 'fixed', 'drop'][CAST(image % 3 AS INTEGER) + 1] AS status, a.d = b.d AS same FROM {_text_digest('cls')} a JOIN {_text_digest('CASE WHEN image % 11 = 0 THEN 0 ELSE cls END')} b USING (image)) GROUP BY 1, 2""",
    "review_list": f"""WITH i AS (SELECT image, 'addition:' || idx AS item FROM {sql_pred(1)} WHERE cls = 3 AND conf >= 0.9 UNION ALL SELECT image, 'conflict:' || idx FROM {SQL_GT} WHERE cls = 2)
        SELECT image, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items, any_value(n) AS n_context FROM i JOIN (SELECT image, count(*) AS n FROM {SQL_GT} GROUP BY image) USING (image) GROUP BY image""",
    "progress_merge": f"""SELECT cls, CASE WHEN k % 2 = 0 THEN 'control' ELSE 'error' END AS selection, CAST(k AS INTEGER) AS rank, CASE WHEN k % 3 = 0 THEN 'note-' || k ELSE '' END AS note FROM (SELECT cls, row_number() OVER (PARTITION BY cls ORDER BY conf DESC, image, idx) AS k FROM {sql_pred(0)}) WHERE k <= 40""",
    "pass_rates": f"""SELECT g_cls AS cls, scale, count(*) AS n, {', '.join(f'round(avg(CAST(iou >= {t / 100} AS INTEGER)), 6) AS pass_{t}' for t in (50, 75, 90))} FROM (SELECT image, g_idx, g_cls, {_SCALE} AS scale, coalesce(round(max({g.iou('g_', 'p_')}) FILTER (g_cls = p_cls), 9), 0) AS iou
        FROM (SELECT * FROM {_sql_pairs(SQL_GT, sql_pred(0), 'g_', 'p_', 'LEFT JOIN')}) GROUP BY ALL) GROUP BY g_cls, scale""",
    "any_hit_benchmark": f"""WITH b AS (SELECT coalesce(max({g.iou('p_', 'g_')}), 0) AS iou FROM (SELECT * FROM {_sql_pairs(f"(SELECT * FROM {sql_pred(2)} WHERE conf >= 0.5)", SQL_GT, 'p_', 'g_', 'LEFT JOIN', 'idx cls cx cy w h conf', 'idx cls cx cy w h')}) GROUP BY image, p_idx)
        SELECT count(*) FILTER (iou >= 0.5) AS tp, round(count(*) FILTER (iou >= 0.5) / count(*), 6) AS precision, round(count(*) FILTER (iou >= 0.5) / (SELECT count(*) FROM lineitem), 6) AS recall FROM b""",
    "run_report": """SELECT model, round(raw, 4) AS raw, round(curated, 4) AS curated, round(curated - raw, 4) AS delta FROM (SELECT regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '_', 'g') AS model, avg(CAST(o_totalprice AS DOUBLE)) FILTER (o_orderkey % 2 = 0) AS raw, avg(CAST(o_totalprice AS DOUBLE)) FILTER (o_orderkey % 2 <> 0) AS curated FROM orders GROUP BY 1)""",
    "training_set": f"""WITH m AS MATERIALIZED (SELECT * FROM {SQL_MANIFEST}), r AS (SELECT digest, split, 'parent' AS origin FROM m WHERE split IN ('train', 'val') UNION ALL SELECT {nz.sql_digest('source_sha256')}, 'train', 'overlay' FROM {_OVL} WHERE n_mapped_boxes > 0
        UNION ALL SELECT digest, 'train', 'synthetic' FROM m WHERE split = 'external_eval' AND width >= 4000)
        SELECT origin, split, count(*) AS n, count(*) FILTER (digest IN (SELECT digest FROM m WHERE split = 'test' AND digest IS NOT NULL)) AS n_in_test, count(*) FILTER (digest IS NULL) AS n_without_digest FROM r GROUP BY origin, split""",
    "pair_packaging": f"""WITH i AS (SELECT {_STEM.format('overlay_image')} AS stem, count(*) AS n FROM {_OVL} GROUP BY 1), l AS (SELECT {_STEM.format('overlay_label')} AS stem, count(*) AS n FROM {_OVL} GROUP BY 1)
        SELECT CASE WHEN i.n IS NULL OR l.n IS NULL THEN 'missing' WHEN i.n > 1 OR l.n > 1 THEN 'ambiguous' ELSE 'pair' END AS status, count(*) AS n FROM i FULL JOIN l ON i.stem = l.stem GROUP BY 1""",
    "label_paths": f"""SELECT kind, count(*) AS n, count(DISTINCT label) AS n_labels, min(label) AS first_label FROM (SELECT DISTINCT manifest_index, {_LABEL} AS label, lower(regexp_extract(image, '\\.([A-Za-z0-9]+)$', 1)) AS kind FROM image_sha256) GROUP BY kind""",
    "anchors": f"SELECT image, CAST(row_number() OVER (PARTITION BY image ORDER BY idx) - 1 AS INTEGER) AS place, idx, round(cx, 6) AS cx, round(cy, 6) AS cy FROM {SQL_GT} WHERE cls = 3",
    "provenance_index": f"""SELECT dataset, '{{"dataset":"' || dataset || '","counts":{{"n_images":' || n || ',"n_digests":' || d || '}},"first_path":"' || replace(p, '\\', '\\\\') || '"}}' AS document FROM (SELECT dataset, count(*) AS n, count(DISTINCT digest) AS d, min(path) AS p FROM {SQL_MANIFEST} WHERE dataset IS NOT NULL GROUP BY dataset)""",
    "tag_choice": """SELECT part, o AS o_orderkey, CASE WHEN o IS NULL THEN 'error' ELSE 'chosen' END AS status FROM (SELECT part, CASE WHEN ne = 1 THEN e WHEN ne = 0 AND nc = 1 THEN c WHEN ne + nc = 0 AND n = 1 THEN a END AS o FROM (SELECT o_custkey % 200 AS part, count(*) FILTER (o_orderkey % 997 = 0) AS ne,
        count(*) FILTER (o_orderkey % 151 = 0) AS nc, count(*) AS n, min(o_orderkey) FILTER (o_orderkey % 997 = 0) AS e, min(o_orderkey) FILTER (o_orderkey % 151 = 0) AS c, min(o_orderkey) AS a FROM orders GROUP BY 1))""",
    "stale_history": """SELECT o_custkey, CAST(k AS INTEGER) AS k, o_orderkey, o_orderpriority = latest AS carried FROM (SELECT *, row_number() OVER w AS k, first_value(o_orderpriority) OVER w AS latest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)) WHERE k <= 10""",
}
