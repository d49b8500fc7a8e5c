"""The label-editing rule engine: rules in a fixed order give boxes and a log, modules can be left out; and edits by review."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import geometry as g
from spanforge.functions.geometry import col
from spanforge.plans.boxes import _SQL_TAGS, _sql_pairs, _tags, pairs
from spanforge.session import Scratch
from spanforge.sources.fixtures import SQL_GT, gt_boxes, pred_boxes, sql_pred

#: The rules in their order.
ORDER = ("G_image", "G_box", "C_syn", "D", "E", "A", "C", "F", "B", "G_add", "H", "I", "P", "0")
#: The modules that an ablation leaves out.
MODULES = {"1": ("A", "B", "F"), "2": ("C_syn", "C", "D"), "3": ("E", "G_image", "G_box", "G_add"), "4": ("H",)}

#: After these rules the boxes are written, as the rule or the next one reads them several times.
READ_AGAIN = ("C_syn", "D", "E", "C", "B", "G_add", "H", "I", "P")

# Thresholds of the rules over the fixture; the fixture's boxes are larger than photographs have.
UNSEEN_IOU, NEST_CONF, NEST_IOU, PERSON_CONF, PERSON_IOU, TINY_SIDE, LABEL_CONF, LABEL_IOA, ADD_CONF, PROPOSAL_CONF, CENTRE = 0.3, 0.6, 0.3, 0.6, 0.5, 0.2, 0.8, 0.2, 0.98, 0.9, 0.025
SYNTHETIC, FLIPPED, DROPPED, BOX_DROPPED = "image % 17 = 0", "image % 13 = 0", "image % 101 = 0", "image % 7 = 1 AND idx = 1"

_BOX = ("cls", "cx", "cy", "w", "h")


class Inputs:
    """What the rules read, written once: labels of the training images with a flag of those that no prediction sees, and the boxes of other models."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.scratch = scratch = Scratch(spark, "rules")
        train = _tags(spark, sf_dir).where("split = 'train'").select("image").distinct()
        gt = gt_boxes(spark, sf_dir).join(train, "image", "left_semi")
        seen = pairs(gt, pred_boxes(spark, sf_dir), "g_", "p_", same_class=True).where(col(f"{g.iou('g_', 'p_')} >= {UNSEEN_IOU}")).select("image", F.col("g_idx").alias("idx"), F.lit(True).alias("seen")).distinct()
        self.boxes = scratch.write(gt.join(seen, ["image", "idx"], "left").withColumn("unseen", F.col("seen").isNull()).drop("seen"), "boxes")
        model = lambda m, where: scratch.write(pred_boxes(spark, sf_dir, m).join(train, "image", "left_semi").where(where), f"model-{m}")
        self.nest = model(0, f"cls = 3 and conf >= {NEST_CONF}")
        self.person = model(1, f"cls = 5 and conf >= {PERSON_CONF}")
        self.tight = model(2, "cls = 0")
        self.more = model(3, f"(cls = 2 and conf >= {ADD_CONF}) or (cls = 0 and conf >= {PROPOSAL_CONF})")


class Run:
    """Boxes (image, idx, cls, cx, cy, w, h, unseen) as the rules change them, and a log (rule, image, n)."""

    def __init__(self, inputs: Inputs, rules: tuple[str, ...]):
        self.inputs, self.boxes, self.log = inputs, inputs.boxes, []
        for rule in ORDER:
            if rule in rules:
                getattr(self, f"_{rule.lower()}")(rule)
                if rule in READ_AGAIN:
                    self.boxes = inputs.scratch.write(self.boxes, rule)

    def _note(self, rule: str, rows: DataFrame) -> None:
        self.log.append(rows.groupBy("image").agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "image", "n"))

    def _drop(self, rule: str, keys: DataFrame, on: list[str]) -> None:
        keys = keys.select(*on).distinct()
        self._note(rule, self.boxes.join(keys, on, "left_semi"))
        self.boxes = self.boxes.join(keys, on, "left_anti")

    def _add(self, rule: str, rows: DataFrame, number: int) -> None:
        """Added boxes are numbered after those of the label, by rule."""
        rows = rows.select("image", (F.col("idx") + 1000 * number).alias("idx"), *_BOX, F.lit(False).alias("unseen"))
        self._note(rule, rows)
        self.boxes = self.boxes.unionByName(rows)

    def _uncovered(self, rows: DataFrame, measure: str, where: str) -> DataFrame:
        """The boxes of ``rows`` whose greatest ``measure`` with any box of the image meets ``where``."""
        met = pairs(rows, self.boxes.drop("unseen"), "p_", "g_", "left").groupBy("image", "p_idx").agg(F.coalesce(F.max(col(measure)), F.lit(0.0)).alias("most")).where(where)
        return rows.join(met.select("image", F.col("p_idx").alias("idx")), ["image", "idx"], "left_semi")

    def _g_image(self, rule: str) -> None:
        self._drop(rule, self.boxes.where(DROPPED), ["image"])

    def _g_box(self, rule: str) -> None:
        self._drop(rule, self.boxes.where(BOX_DROPPED), ["image", "idx"])

    def _c_syn(self, rule: str) -> None:
        self._drop(rule, self.inputs.person.where(SYNTHETIC), ["image"])

    def _d(self, rule: str) -> None:
        self._drop(rule, self.boxes.where(f"{SYNTHETIC} AND cls = 4 AND unseen"), ["image"])

    def _e(self, rule: str) -> None:
        self._drop(rule, self.boxes.where(f"NOT {SYNTHETIC} AND cls in (4, 5) AND unseen"), ["image"])

    def _a(self, rule: str) -> None:
        self._note(rule, self.boxes.where(FLIPPED))
        self.boxes = self.boxes.withColumn("cx", F.when(F.expr(FLIPPED), 1 - F.col("cx")).otherwise(F.col("cx")))

    def _c(self, rule: str) -> None:
        hit = pairs(self.boxes.where("cls = 4").drop("unseen"), self.inputs.person, "g_", "p_").where(col(f"{g.iou('g_', 'p_')} >= {PERSON_IOU}"))
        self._drop(rule, hit.select("image", F.col("g_idx").alias("idx")), ["image", "idx"])

    def _f(self, rule: str) -> None:
        self._drop(rule, self.boxes.where(f"least(w, h) < {TINY_SIDE}"), ["image", "idx"])

    def _b(self, rule: str) -> None:
        self._add(rule, self._uncovered(self.inputs.nest, g.iou("p_", "g_"), f"most < {NEST_IOU}"), 1)

    def _g_add(self, rule: str) -> None:
        self._add(rule, self.inputs.more.where("cls = 2"), 2)

    def _h(self, rule: str) -> None:
        near = pairs(self.boxes.where("cls = 0").drop("unseen"), self.inputs.tight, "g_", "t_").where(f"abs(g_cx - t_cx) < {CENTRE} and abs(g_cy - t_cy) < {CENTRE}")
        first = near.groupBy("image", F.col("g_idx").alias("idx")).agg(F.min(F.struct("t_idx", "t_cx", "t_cy", "t_w", "t_h")).alias("t"))
        joined = self.boxes.join(first, ["image", "idx"], "left")
        self._note(rule, joined.where("t is not null"))
        self.boxes = joined.select("image", "idx", "cls", *[F.coalesce(f"t.t_{c}", c).alias(c) for c in _BOX[1:]], "unseen")

    def _i(self, rule: str) -> None:
        self._add(rule, self.inputs.more.where("cls = 0").join(self.boxes.where("cls = 0").select("image").distinct(), "image", "left_anti"), 3)

    def _p(self, rule: str) -> None:
        self._add(rule, self._uncovered(self.inputs.person.where(f"conf >= {LABEL_CONF}"), g.ioa("p_", "g_"), f"most <= {LABEL_IOA}").withColumn("cls", F.lit(6)), 4)

    def _0(self, rule: str) -> None:
        self._drop(rule, self.boxes.where("cls = 0"), ["image", "idx"])
        self.boxes = self.boxes.withColumn("cls", F.col("cls") - 1)


def rules_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of the training images after all rules."""
    return Run(Inputs(spark, sf_dir), ORDER).boxes.select("image", "idx", "cls", *[F.round(c, 6).alias(c) for c in _BOX[1:]])


def rules_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and boxes that each rule changed."""
    log = reduce(DataFrame.unionByName, Run(Inputs(spark, sf_dir), ORDER).log)
    return log.groupBy("rule").agg(F.count("*").alias("n_images"), F.sum("n").alias("n_boxes"))


def _variants() -> dict[str, tuple[str, ...]]:
    names = list(MODULES)
    cumulative = {"with_" + "".join(names[: i + 1]): tuple(r for m in names[: i + 1] for r in MODULES[m]) for i in range(len(names))}
    return cumulative | {f"without_{m}": tuple(r for k in names if k != m for r in MODULES[k]) for m in names}


def rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left with the modules up to each one, and with each one left out."""
    inputs = Inputs(spark, sf_dir)
    parts = [Run(inputs, rules).boxes.agg(F.lit(name).alias("variant"), F.count("*").alias("n_boxes"), F.countDistinct("image").alias("n_images")) for name, rules in _variants().items()]
    return reduce(DataFrame.unionByName, parts)


def review_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed class changes find their label by the centre: applied only if exactly one label is there."""
    decided = pred_boxes(spark, sf_dir, 2).where("conf >= 0.9")
    near = pairs(decided, gt_boxes(spark, sf_dir), "p_", "g_", "left")
    hit = F.col("g_idx").isNotNull() & (F.abs(F.col("p_cx") - F.col("g_cx")) < 0.035) & (F.abs(F.col("p_cy") - F.col("g_cy")) < 0.035)
    counts = near.groupBy("image", "p_idx").agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("g_idx"))).alias("g"))
    status = F.when(F.col("n") == 1, "applied").when(F.col("n") == 0, "no_label").otherwise("ambiguous")
    return counts.select("image", F.col("p_idx").alias("idx"), status.alias("status"), F.when(F.col("n") == 1, F.col("g")).alias("label_idx"))


def indexed_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals by line number carry the line as it was; one whose line has changed is a conflict, others change the class or remove the box."""
    gt = gt_boxes(spark, sf_dir)
    line = F.format_string("%d %.6f %.6f", "cls", "cx", "cy")
    now = gt.select("image", "idx", F.when((F.col("image") % 23 == 0) & (F.col("idx") == 0), F.concat(line, F.lit(" edited"))).otherwise(line).alias("now"))
    wanted = gt.where("cls = 5 or cls = 1").select("image", "idx", line.alias("old"), F.when(F.col("cls") == 5, "remove").otherwise("reclass").alias("action"))
    both = wanted.join(now, ["image", "idx"], "left")
    return both.select("image", "idx", F.when(F.col("now").eqNullSafe(F.col("old")), F.col("action")).otherwise("conflict").alias("outcome"))


def best_box_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reviewed box removes the label that overlaps it most, from an IoU above 0.9 on; a label that two remove, or a review that finds none, breaks the expected count."""
    reviewed = pred_boxes(spark, sf_dir, 1).where("conf >= 0.95")
    both = pairs(reviewed, gt_boxes(spark, sf_dir), "p_", "g_", "left").withColumn("iou", F.round(col(g.iou("p_", "g_")), 9))
    best = both.groupBy("image", "p_idx").agg(F.max(F.when(F.col("iou") > 0.9, F.struct("iou", (-F.col("g_idx")).alias("g")))).alias("b"))
    rows = best.select("image", "p_idx", (-F.col("b.g")).alias("g_idx"))
    taken = rows.where("g_idx is not null").groupBy("image", "g_idx").agg(F.count("*").alias("n"))
    a = rows.agg(F.lit("reviews").alias("what"), F.count("*").alias("n"))
    b = rows.agg(F.lit("without_label").alias("what"), F.count_if(F.col("g_idx").isNull()).alias("n"))
    c = taken.agg(F.lit("labels_dropped").alias("what"), F.count("*").alias("n"))
    return a.unionByName(b).unionByName(c).unionByName(taken.agg(F.lit("taken_twice").alias("what"), F.count_if(F.col("n") > 1).alias("n")))


def long_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long boxes of class 5 (aspect of 3, or a side of 0.6) and the share that their two best predictions cover together: found, keep or review."""
    long = gt_boxes(spark, sf_dir).where("cls = 5 and (greatest(w / h, h / w) >= 3 or greatest(w, h) >= 0.6)")
    both = pairs(long, pred_boxes(spark, sf_dir, 0), "g_", "p_", "left").withColumn("ioa", F.coalesce(F.round(col(g.ioa("g_", "p_")), 9), F.lit(0.0)))
    k = F.row_number().over(Window.partitionBy("image", "g_idx").orderBy(F.desc("ioa"), "p_idx"))
    two = both.withColumn("k", k).where("k <= 2").groupBy("image", "g_idx").agg(F.max("ioa").alias("one"), F.least(F.sum("ioa"), F.lit(1.0)).alias("most"))
    kind = F.when(F.col("one") >= 0.7, "found").when(F.col("most") >= 0.7, "review").otherwise("keep")
    return two.select("image", F.col("g_idx").alias("idx"), kind.alias("kind"), F.round("most", 6).alias("share"))


def accepted_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with accepted additions behind them: the lines before stay as they are; per image the counts before and after."""
    gt = gt_boxes(spark, sf_dir)
    new = pred_boxes(spark, sf_dir, 3).where("cls = 3 and conf >= 0.9")
    size = gt.groupBy("image").agg(F.count("*").alias("n_before"))
    place = F.row_number().over(Window.partitionBy("image").orderBy("idx"))
    added = new.join(size, "image").select("image", (F.col("n_before") + place - 1).cast("int").alias("idx"), "cls")
    rows = gt.select("image", "idx", "cls").unionByName(added)
    return rows.groupBy("image").agg(F.count("*").alias("n_after"), F.max("idx").alias("last_idx"), F.count_if(F.col("cls") == 3).alias("n_class_3")).join(size, "image")


QUERIES: dict[str, Callable] = {f.__name__: f for f in (rules_boxes, rules_log, rules_ablation, review_matches, indexed_proposals, best_box_dropped, long_strands, accepted_additions)}


def _sql_run(rules: tuple[str, ...]) -> tuple[str, list[str], str]:
    """The chain as common table expressions: their text, the logs, and the name of the last table."""
    seen = f"SELECT DISTINCT image, g_idx FROM {_sql_pairs(SQL_GT, sql_pred(0), 'g_', 'p_')} WHERE g_cls = p_cls AND {g.iou('g_', 'p_')} >= {UNSEEN_IOU}"
    parts = [
        f"train AS MATERIALIZED (SELECT DISTINCT image FROM {_SQL_TAGS} WHERE split = 'train')",
        f"b0 AS MATERIALIZED (SELECT b.*, (b.image, b.idx) NOT IN (SELECT (image, g_idx) FROM ({seen})) AS unseen FROM {SQL_GT} b WHERE image IN (SELECT image FROM train))",
        f"nest AS MATERIALIZED (SELECT * FROM {sql_pred(0)} WHERE cls = 3 AND conf >= {NEST_CONF} AND image IN (SELECT image FROM train))",
        f"person AS MATERIALIZED (SELECT * FROM {sql_pred(1)} WHERE cls = 5 AND conf >= {PERSON_CONF} AND image IN (SELECT image FROM train))",
        f"tight AS MATERIALIZED (SELECT * FROM {sql_pred(2)} WHERE cls = 0 AND image IN (SELECT image FROM train))",
        f"more AS MATERIALIZED (SELECT * FROM {sql_pred(3)} WHERE image IN (SELECT image FROM train))",
    ]
    logs: list[str] = []
    now = "b0"

    def step(rule: str, kept: str, changed: str) -> None:
        nonlocal now
        after = f"b{len(parts)}"
        logs.append(f"SELECT '{rule}' AS rule, image, count(*) AS n FROM ({changed}) GROUP BY image")
        parts.append(f"{after} AS MATERIALIZED ({kept})")
        now = after

    def drop(rule: str, condition: str) -> None:
        step(rule, f"SELECT * FROM {now} WHERE NOT ({condition})", f"SELECT * FROM {now} WHERE {condition}")

    def add(rule: str, rows: str, number: int, cls: str = "cls") -> None:
        new = f"SELECT image, idx + {1000 * number} AS idx, {cls} AS cls, cx, cy, w, h, false AS unseen FROM ({rows})"
        step(rule, f"SELECT image, idx, cls, cx, cy, w, h, unseen FROM {now} UNION ALL {new}", new)

    def uncovered(rows: str, measure: str, condition: str) -> str:
        joined = _sql_pairs(rows, now, "p_", "g_", "LEFT JOIN", "idx cls cx cy w h conf", "idx cls cx cy w h")
        return f"SELECT * FROM {rows} x WHERE (image, idx) IN (SELECT (image, p_idx) FROM (SELECT * FROM {joined}) GROUP BY image, p_idx HAVING coalesce(max({measure}), 0) {condition})"

    for rule in ORDER:
        if rule not in rules:
            continue
        if rule == "G_image":
            drop(rule, DROPPED)
        elif rule == "G_box":
            drop(rule, BOX_DROPPED)
        elif rule == "C_syn":
            drop(rule, f"image IN (SELECT image FROM person WHERE {SYNTHETIC})")
        elif rule == "D":
            drop(rule, f"image IN (SELECT image FROM {now} WHERE {SYNTHETIC} AND cls = 4 AND unseen)")
        elif rule == "E":
            drop(rule, f"image IN (SELECT image FROM {now} WHERE NOT {SYNTHETIC} AND cls IN (4, 5) AND unseen)")
        elif rule == "A":
            step(rule, f"SELECT image, idx, cls, CASE WHEN {FLIPPED} THEN 1 - cx ELSE cx END AS cx, cy, w, h, unseen FROM {now}", f"SELECT * FROM {now} WHERE {FLIPPED}")
        elif rule == "C":
            hit = f"SELECT (image, g_idx) FROM {_sql_pairs(now, 'person', 'g_', 'p_')} WHERE g_cls = 4 AND {g.iou('g_', 'p_')} >= {PERSON_IOU}"
            drop(rule, f"(image, idx) IN ({hit})")
        elif rule == "F":
            drop(rule, f"least(w, h) < {TINY_SIDE}")
        elif rule == "B":
            add(rule, uncovered("nest", g.iou("p_", "g_"), f"< {NEST_IOU}"), 1)
        elif rule == "G_add":
            add(rule, f"SELECT * FROM more WHERE cls = 2 AND conf >= {ADD_CONF}", 2)
        elif rule == "H":
            near = f"SELECT image, g_idx, t_cx, t_cy, t_w, t_h, row_number() OVER (PARTITION BY image, g_idx ORDER BY t_idx) AS k FROM {_sql_pairs(now, 'tight', 'g_', 't_')} WHERE g_cls = 0 AND abs(g_cx - t_cx) < {CENTRE} AND abs(g_cy - t_cy) < {CENTRE}"
            joined = f"{now} b {{}} JOIN (SELECT * FROM ({near}) WHERE k = 1) t ON t.image = b.image AND t.g_idx = b.idx"
            step(rule, f"SELECT b.image, b.idx, b.cls, coalesce(t_cx, cx) AS cx, coalesce(t_cy, cy) AS cy, coalesce(t_w, w) AS w, coalesce(t_h, h) AS h, unseen FROM {joined.format('LEFT')}", f"SELECT b.image FROM {joined.format('')}")
        elif rule == "I":
            add(rule, f"SELECT * FROM more WHERE cls = 0 AND conf >= {PROPOSAL_CONF} AND image NOT IN (SELECT image FROM {now} WHERE cls = 0)", 3)
        elif rule == "P":
            parts.append(f"sure AS MATERIALIZED (SELECT * FROM person WHERE conf >= {LABEL_CONF})")
            add(rule, uncovered("sure", g.ioa("p_", "g_"), f"<= {LABEL_IOA}"), 4, "6")
        elif rule == "0":
            step(rule, f"SELECT image, idx, cls - 1 AS cls, cx, cy, w, h, unseen FROM {now} WHERE cls <> 0", f"SELECT * FROM {now} WHERE cls = 0")
    return ", ".join(parts), logs, now


def _sql_variant(name: str, rules: tuple[str, ...]) -> str:
    text, _, last = _sql_run(rules)
    return f"SELECT * FROM (WITH {text} SELECT '{name}' AS variant, count(*) AS n_boxes, count(DISTINCT image) AS n_images FROM {last})"


_ALL, _LOGS, _LAST = _sql_run(ORDER)
_LINE = "printf('%d %.6f %.6f', cls, cx, cy)"
_BEST = f"""SELECT image, p_idx, arg_max(g_idx, (iou, -g_idx)) FILTER (iou > 0.9) AS g_idx FROM (SELECT *, round({g.iou('p_', 'g_')}, 9) AS iou
    FROM {_sql_pairs(f"(SELECT * FROM {sql_pred(1)} WHERE conf >= 0.95)", SQL_GT, 'p_', 'g_', 'LEFT JOIN', 'idx cls cx cy w h conf', 'idx cls cx cy w h')}) GROUP BY image, p_idx"""
_NEAR = "g_idx IS NOT NULL AND abs(p_cx - g_cx) < 0.035 AND abs(p_cy - g_cy) < 0.035"

SQL = {
    "rules_boxes": f"WITH {_ALL} SELECT image, idx, cls, round(cx, 6) AS cx, round(cy, 6) AS cy, round(w, 6) AS w, round(h, 6) AS h FROM {_LAST}",
    "rules_log": f"WITH {_ALL} SELECT rule, count(*) AS n_images, CAST(sum(n) AS BIGINT) AS n_boxes FROM ({' UNION ALL '.join(_LOGS)}) GROUP BY rule",
    "rules_ablation": " UNION ALL ".join(_sql_variant(n, r) for n, r in _variants().items()),
    "review_matches": f"""SELECT image, p_idx AS idx, CASE n WHEN 1 THEN 'applied' WHEN 0 THEN 'no_label' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN g END AS label_idx FROM (SELECT image, p_idx, count(*) FILTER ({_NEAR}) AS n, min(g_idx) FILTER ({_NEAR}) AS g
        FROM (SELECT * FROM {_sql_pairs(f"(SELECT * FROM {sql_pred(2)} WHERE conf >= 0.9)", SQL_GT, 'p_', 'g_', 'LEFT JOIN', 'idx cls cx cy w h conf', 'idx cls cx cy w h')}) GROUP BY image, p_idx)""",
    "indexed_proposals": f"SELECT image, idx, CASE WHEN image % 23 = 0 AND idx = 0 THEN 'conflict' WHEN cls = 5 THEN 'remove' ELSE 'reclass' END AS outcome FROM {SQL_GT} WHERE cls IN (1, 5)",
    "best_box_dropped": f"""WITH r AS MATERIALIZED ({_BEST}), t AS (SELECT image, g_idx, count(*) AS n FROM r WHERE g_idx IS NOT NULL GROUP BY image, g_idx) SELECT 'reviews' AS what, count(*) AS n FROM r UNION ALL SELECT 'without_label', count(*) FILTER (g_idx IS NULL) FROM r
        UNION ALL SELECT 'labels_dropped', count(*) FROM t UNION ALL SELECT 'taken_twice', count(*) FILTER (n > 1) FROM t""",
    "long_strands": f"""SELECT image, g_idx AS idx, CASE WHEN one >= 0.7 THEN 'found' WHEN most >= 0.7 THEN 'review' ELSE 'keep' END AS kind, round(most, 6) AS share FROM (SELECT image, g_idx, max(ioa) AS one, least(sum(ioa), 1.0) AS most
        FROM (SELECT *, row_number() OVER (PARTITION BY image, g_idx ORDER BY ioa DESC, p_idx) AS k FROM (SELECT *, coalesce(round({g.ioa('g_', 'p_')}, 9), 0.0) AS ioa
          FROM {_sql_pairs(f"(SELECT * FROM {SQL_GT} WHERE cls = 5 AND (greatest(w / h, h / w) >= 3 OR greatest(w, h) >= 0.6))", sql_pred(0), 'g_', 'p_', 'LEFT JOIN')})) WHERE k <= 2 GROUP BY image, g_idx)""",
    "accepted_additions": f"""WITH g AS MATERIALIZED (SELECT image, idx, cls FROM {SQL_GT}), s AS (SELECT image, count(*) AS n_before FROM g GROUP BY image),
        a AS (SELECT p.image, CAST(n_before + row_number() OVER (PARTITION BY p.image ORDER BY p.idx) - 1 AS INTEGER) AS idx, p.cls FROM {sql_pred(3)} p JOIN s USING (image) WHERE p.cls = 3 AND p.conf >= 0.9)
        SELECT image, count(*) AS n_after, max(idx) AS last_idx, count(*) FILTER (cls = 3) AS n_class_3, any_value(n_before) AS n_before FROM (SELECT * FROM g UNION ALL SELECT * FROM a) JOIN s USING (image) GROUP BY image""",
}
