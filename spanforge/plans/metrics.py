"""Detection metrics: average precision, bootstrap, gates, sweeps and statistics of scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.plans import duplicates
from spanforge.plans.boxes import _masked, masked_matches, sql_masked
from spanforge.sources.fixtures import SQL_GT, gt_boxes, pred_boxes
from spanforge.sources.tables import table

GRID = 100
REPLICATES = 20
ROUNDS, ROUNDS_A_TASK, TARGET = 1000, 50, 0.82
TAUS = (0.05, 0.2, 0.4, 0.6, 0.8)


def average_precision(matched: DataFrame, totals: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """101-point average precision per group ``by``.

    ``matched`` has conf and tp (0 or 1) of each prediction, ``totals`` the number ``npos`` of labels. Predictions with
    equal confidence are one step of the curve, so that their order doesn't matter. The precision envelope
    is interpolated linearly over recall at 101 points and integrated by trapezoids. A group
    without labels or without predictions has 0. All predictions of a confidence are summed
    before the running sums, so the windows see at most as many rows as there are confidences.
    """
    w = F.lit(1.0) if weight is None else weight
    steps = matched.groupBy(*by, "conf").agg(F.sum(F.col("tp") * w).alias("t"), F.sum(w).alias("n")).where("n > 0")
    run = Window.partitionBy(*by).orderBy(F.desc("conf"))
    total = run.rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.withColumn("ct", F.sum("t").over(total)).withColumn("cn", F.sum("n").over(total)).join(totals.where("npos > 0"), by)
    curve = curve.withColumn("rec", F.col("ct") / F.col("npos")).withColumn("prec", F.col("ct") / F.col("cn"))
    curve = curve.withColumn("env", F.max("prec").over(run.rowsBetween(0, Window.unboundedFollowing)))
    # of equal recalls the last point counts
    points = curve.groupBy(*by, "rec").agg(F.min("env").alias("env"), F.max("env").alias("top"))
    along = Window.partitionBy(*by).orderBy("rec")
    points = points.withColumn("r0", F.coalesce(F.lag("rec").over(along), F.lit(0.0))).withColumn("e0", F.coalesce(F.lag("env").over(along), F.lit(1.0))).withColumn("r1", F.lead("rec").over(along))
    inner = points.where("rec > r0").select(*by, "r0", F.col("e0").alias("y0"), F.col("rec").alias("x1"), F.col("top").alias("y1"))
    tail = points.where("r1 is null").select(*by, F.col("rec").alias("r0"), F.col("env").alias("y0"), F.lit(1.0).alias("x1"), F.lit(0.0).alias("y1")).where("r0 < 1")
    segments = inner.unionByName(tail)
    low, high = F.ceil(F.col("r0") * GRID - 1e-9), F.ceil(F.col("x1") * GRID - 1e-9) - 1
    high = F.when(F.col("x1") >= 1, F.lit(GRID)).otherwise(high)
    grid = segments.withColumn("q", F.explode(F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))))
    y = F.col("y0") + (F.col("q") / GRID - F.col("r0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("r0"))
    share = F.when(F.col("q").isin(0, GRID), 0.5).otherwise(1.0) / GRID
    ap = grid.groupBy(*by).agg(F.sum(y * share).alias("ap"))
    return totals.join(ap, by, "left").select(*by, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def sql_ap(matched: str, totals: str, by: str, weight: str = "1") -> str:
    """The same by a scan of the curve at each point of the grid."""
    return f"""(WITH st AS (SELECT {by}, conf, sum(tp * {weight}) AS t, CAST(sum({weight}) AS DOUBLE) AS n FROM {matched} GROUP BY {by}, conf HAVING n > 0),
      cu AS (SELECT *, sum(t) OVER w AS ct, sum(n) OVER w AS cn FROM st WINDOW w AS (PARTITION BY {by} ORDER BY conf DESC ROWS UNBOUNDED PRECEDING)),
      pr AS (SELECT {', '.join('cu.' + b.strip() for b in by.split(','))}, conf, ct / npos AS rec, ct / cn AS prec FROM cu JOIN {totals} USING ({by}) WHERE npos > 0),
      en AS (SELECT {by}, rec, max(prec) OVER (PARTITION BY {by} ORDER BY conf DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM pr),
      po AS (SELECT {by}, rec, min(env) AS env, max(env) AS top FROM en GROUP BY {by}, rec),
      al AS (SELECT {by}, rec, env, top FROM po UNION ALL SELECT DISTINCT {by}, -1e-12, 1.0, 1.0 FROM po UNION ALL SELECT {by}, 1.0 + 1e-12, 0.0, 0.0 FROM po GROUP BY {by}),
      sg AS (SELECT {by}, greatest(lag(rec) OVER w, 0) AS x0, lag(env) OVER w AS y0, least(rec, 1.0) AS x1, top AS y1 FROM al WINDOW w AS (PARTITION BY {by} ORDER BY rec)),
      gr AS (SELECT {by}, q, y0 + (q / 100.0::DOUBLE - x0) * (y1 - y0) / (x1 - x0) AS y FROM sg, range(0, 101) g(q)
             WHERE x1 > x0 AND q >= ceil(x0 * 100 - 1e-9) AND (q <= ceil(x1 * 100 - 1e-9) - 1 OR (x1 >= 1 AND q <= 100)))
      SELECT {by}, coalesce(sum(y * CASE WHEN q IN (0, 100) THEN 0.5 ELSE 1.0 END / 100), 0) AS ap FROM {totals} LEFT JOIN gr USING ({by}) GROUP BY {by})"""


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gt_boxes(spark, sf_dir).groupBy("cls").agg(F.count("*").alias("npos"))


_SQL_TOTALS = f"(SELECT cls, count(*) AS npos FROM {SQL_GT} GROUP BY cls)"


STEPS = tuple(range(50, 100, 5))


def ap101(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_precision(_masked(spark, sf_dir), _totals(spark, sf_dir), ["cls"]).select("cls", F.round("ap", 6).alias("ap50"))


def profile(spark: SparkSession, sf_dir: str, model: int = 0) -> DataFrame:
    """Per class AP at 0.5, its mean over the ten thresholds to 0.95, and AP at 0.75, 0.9 and 0.95: one join of the pairs for all."""
    at = F.explode(F.arrays_zip(F.array(*[F.lit(t) for t in STEPS]).alias("step"), F.col("tp").alias("tp"))).alias("x")
    rows = masked_matches(pred_boxes(spark, sf_dir, model), gt_boxes(spark, sf_dir), tuple(t / 100 for t in STEPS)).select("cls", "conf", at).select("cls", "conf", F.col("x.step").alias("step"), F.col("x.tp").alias("tp"))
    totals = _totals(spark, sf_dir).select("*", F.explode(F.array(*[F.lit(t) for t in STEPS])).alias("step"))
    ap = average_precision(rows, totals, ["cls", "step"])
    named = {f"ap{t}": F.max(F.when(F.col("step") == t, F.col("ap"))) for t in (50, 75, 90, 95)}
    return ap.groupBy("cls").agg(F.avg("ap").alias("ap50_95"), *[c.alias(k) for k, c in named.items()])


def strict_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of model 0, with the gap between AP50 and AP50_95."""
    wide = profile(spark, sf_dir)
    return wide.select("cls", *[F.round(c, 6).alias(c) for c in ("ap50", "ap50_95", "ap75", "ap90", "ap95")], F.round(F.col("ap50") - F.col("ap50_95"), 6).alias("gap"))


def ap50_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mAP50 and mAP50-95 of four models, and MEAN_5 (classes from 1 on; one without labels counts as 0)."""
    out = None
    for model in range(4):
        one = profile(spark, sf_dir, model).agg(F.avg("ap50").alias("a"), F.avg("ap50_95").alias("b"), (F.sum(F.when(F.col("cls") >= 1, F.col("ap50"))) / 5).alias("c"))
        one = one.select(F.lit(model).alias("model"), F.round("a", 6).alias("map50"), F.round("b", 6).alias("map50_95"), F.round("c", 6).alias("mean5"))
        out = one if out is None else out.unionByName(one)
    return out


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class, and for all (class null), AP50 and AP50_95 of a base model and a candidate."""
    base, new = (profile(spark, sf_dir, m).select("cls", F.col("ap50").alias(f"{p}_ap50"), F.col("ap50_95").alias(f"{p}_ap50_95")) for m, p in ((0, "base"), (1, "new")))
    rows = base.join(new, "cls")
    names = [c for c in rows.columns if c != "cls"]
    return rows.rollup("cls").agg(*[F.avg(c).alias(c) for c in names])


def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate beside the base, per class and for all, with differences to four digits."""
    rows = _compared(spark, sf_dir)
    shown = [F.round(c, 4).alias(c) for c in rows.columns if c != "cls"]
    return rows.select(F.coalesce(F.col("cls").cast("string"), F.lit("ALL")).alias("class"), *shown, *[F.round(F.col(f"new_{c}") - F.col(f"base_{c}"), 4).alias(f"d_{c}") for c in ("ap50", "ap50_95")])


def mean5_gate(spark: SparkSession, sf_dir: str, regression: float = 0.01, foreign: float = 0.02, foreign_strict: float = 0.01, strand_strict: float = 0.01) -> DataFrame:
    """May the candidate replace the base? Four inequalities: mAP50-95 hardly worse, AP50 and AP50-95 of class 4 and AP50-95 of class 5 better. A missing class counts as 0."""
    rows = _compared(spark, sf_dir)
    v = lambda c, k=None: F.coalesce(F.max(F.when(F.col("cls").isNull() if k is None else F.col("cls") == k, F.col(c))), F.lit(0.0))
    one = rows.agg(
        (v("new_ap50_95") >= v("base_ap50_95") - regression).alias("global_holds"), (v("new_ap50", 4) >= v("base_ap50", 4) + foreign).alias("foreign_ap50_gains"),
        (v("new_ap50_95", 4) >= v("base_ap50_95", 4) + foreign_strict).alias("foreign_ap50_95_gains"), (v("new_ap50_95", 5) >= v("base_ap50_95", 5) + strand_strict).alias("strand_ap50_95_gains"),
    )
    return one.withColumn("candidate_pass", F.col("global_holds") & F.col("foreign_ap50_gains") & F.col("foreign_ap50_95_gains") & F.col("strand_ap50_95_gains"))


def two_tier_gate(spark: SparkSession, sf_dir: str, tau: float = 0.9) -> DataFrame:
    """A small model flags images with a defect; only those get the boxes of a large one, and those of class 4 from a second large one."""
    flagged = _masked(spark, sf_dir, model=0).where((F.col("cls") >= 1) & (F.col("conf") >= tau)).select("image").distinct()
    served = _masked(spark, sf_dir, model=1).where("cls <> 4").unionByName(_masked(spark, sf_dir, model=2).where("cls = 4"))
    system = served.join(flagged, "image", "left_semi")
    return average_precision(system, _totals(spark, sf_dir), ["cls"]).select("cls", F.round("ap", 6).alias("ap50"))


def tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per threshold of the flag: share of images sent on, and MEAN_5."""
    flags = _masked(spark, sf_dir, model=0).where("cls >= 1").groupBy("image").agg(F.max("conf").alias("top"))
    taus = F.explode(F.array(*[F.lit(t) for t in TAUS])).alias("tau")
    system = _masked(spark, sf_dir, model=1).join(flags, "image").select("*", taus).where("top >= tau")
    totals = _totals(spark, sf_dir).select("*", taus)
    mean = average_precision(system, totals, ["tau", "cls"]).groupBy("tau").agg((F.sum(F.when(F.col("cls") >= 1, F.col("ap"))) / 5).alias("mean5"))
    images = gt_boxes(spark, sf_dir).agg(F.countDistinct("image").alias("n"))
    sent = flags.select("*", taus).where("top >= tau").groupBy("tau").agg(F.count("*").alias("k"))
    return mean.join(sent, "tau", "left").crossJoin(F.broadcast(images)).select("tau", F.round(F.coalesce("k", F.lit(0)) / F.col("n"), 6).alias("sent"), F.round("mean5", 6).alias("mean5"))


def _poisson(u: Column) -> Column:
    """A Poisson(1) number from a fraction."""
    out, p, c = F.lit(6), 0.36787944117144233, 0.36787944117144233
    cuts = []
    for k in range(6):
        cuts.append((k, c))
        p /= k + 1
        c += p
    for k, cut in reversed(cuts):
        out = F.when(u < cut, F.lit(k)).otherwise(out)
    return out


def _sql_poisson(u: str) -> str:
    p = c = 0.36787944117144233
    parts = []
    for k in range(6):
        parts.append(f"WHEN {u} < {c!r} THEN {k}")
        p /= k + 1
        c += p
    return f"CASE {' '.join(parts)} ELSE 6 END"


def _fraction(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("double") / F.lit(281474976710656.0)


def bootstrap_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP per class of the first 20 weighted resamples of the images (digest weights, for the check in SQL; intervals come from ``bootstrap_intervals``)."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("rep")
    weight = _poisson(_fraction(F.concat_ws(":", F.col("image").cast("string"), F.col("rep").cast("string"))))
    matched = _masked(spark, sf_dir).select("*", reps).withColumn("w", weight.cast("double"))
    totals = gt_boxes(spark, sf_dir).groupBy("image", "cls").agg(F.count("*").alias("n")).select("*", reps).groupBy("rep", "cls").agg(F.sum(F.col("n") * weight).alias("npos"))
    return average_precision(matched, totals, ["rep", "cls"], F.col("w")).select("rep", "cls", F.round("ap", 6).alias("ap50"))


def bootstrap_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP per class over 1000 resamples of the images: mean and 95 % limits. Matches are made once, then weighted."""
    matched = _masked(spark, sf_dir).select("cls", "conf", "tp", F.lit(0).alias("model"), F.col("image").cast("bigint").alias("unit"))
    ap = bootstrap_ap(matched, gt_boxes(spark, sf_dir).select("cls", F.col("image").cast("bigint").alias("unit"))).where("round > 0")
    q = lambda p: F.round(F.percentile("ap", p), 6)  # noqa: E731 - 1000 values a class
    return ap.groupBy("cls").agg(F.round(F.avg("ap"), 6).alias("mean_ap"), q(0.025).alias("low"), q(0.975).alias("high"), F.count("*").alias("rounds"))


_CUTS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def poisson_weights(units: np.ndarray, rounds: int) -> np.ndarray:
    """A Poisson(1) number for each unit (a hash) and round, the same wherever it is asked for; before them a column of ones: the sample itself."""
    with np.errstate(over="ignore"):
        x = units.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.c_[np.ones(len(u), np.int64), np.searchsorted(_CUTS, u.ravel(), "right").reshape(u.shape)]


def weighted_ap(t: np.ndarray, n: np.ndarray, npos: float) -> float:
    """``average_precision`` of one curve: weights of hits and of predictions at each confidence, the surest first."""
    ct, cn = np.cumsum(t)[n > 0], np.cumsum(n)[n > 0]
    if not len(cn) or npos <= 0:
        return 0.0
    rec, env = ct / npos, np.maximum.accumulate((ct / cn)[::-1])[::-1]
    x = np.arange(GRID + 1) / GRID
    y = np.interp(x + 1e-11, np.r_[0, rec, max(1.0, rec[-1])], np.r_[1, env, 0 if rec[-1] < 1 else env[-1]])
    y[-1] = env[np.argmax(rec >= 1)] if rec[-1] >= 1 else 0.0
    return float(np.trapezoid(y, x))


def _weigh(rounds: int) -> Callable:
    """Rows sorted by (model, cls, conf) -> sums of weights of each of these, in slices of rounds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, t, n = None, None, None

        def slices() -> pd.DataFrame:
            cuts = range(0, rounds + 1, ROUNDS_A_TASK)
            return pd.DataFrame([(*key, c, t[c : c + ROUNDS_A_TASK], n[c : c + ROUNDS_A_TASK]) for c in cuts], columns=["model", "cls", "conf", "first", "t", "n"])

        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                weights, keys = poisson_weights(part["unit"].to_numpy(), rounds), part[["model", "cls", "conf"]].to_numpy()
                starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
                ts, ns = (np.add.reduceat(weights * part[c].to_numpy()[:, None], starts, axis=0) for c in ("t", "n"))
                out = []
                for k, a in enumerate(starts):
                    now = (int(keys[a, 0]), int(keys[a, 1]), float(keys[a, 2]))
                    if now == key:
                        t, n = t + ts[k], n + ns[k]
                        continue
                    if key is not None:
                        out.append(slices())
                    key, t, n = now, ts[k], ns[k]
                if out:
                    yield pd.concat(out, ignore_index=True)
        if key is not None:
            yield slices()

    return run


def _curves(frame: pd.DataFrame) -> pd.DataFrame:
    """AP of each round of a slice; rows with model -1 count the labels."""
    t, n = np.stack(frame["t"].to_numpy()), np.stack(frame["n"].to_numpy())
    model, first = frame["model"].to_numpy(), int(frame["first"].iloc[0])
    npos, out = n[model < 0].sum(0), []
    for m in sorted({*frame["models"].iloc[0]}):
        at = np.flatnonzero(model == m)
        at = at[np.argsort(-frame["conf"].to_numpy()[at], kind="stable")]
        out += [(m, int(frame["cls"].iloc[0]), first + r, weighted_ap(t[at, r], n[at, r], npos[r])) for r in range(n.shape[1])]
    return pd.DataFrame(out, columns=["model", "cls", "round", "ap"])


def bootstrap_ap(matched: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(model, cls, round, ap) over resamples of units; round 0 is the sample itself.

    ``matched`` (model, cls, conf, tp, unit) has the predictions of all models, ``labels`` (cls, unit) the labels. Weights depend on the unit and
    the round only, so that models are compared on the same resamples. Matches are summed per unit and confidence, then weighted
    in each task for all rounds at once; what is sent on are sums per confidence, in slices of rounds. A task has the curves
    of one class for ``ROUNDS_A_TASK`` rounds. The sums of labels are made in 16 parts a class.
    """
    models = sorted(r[0] for r in matched.select("model").distinct().collect())
    steps = matched.groupBy("model", "cls", "conf", F.xxhash64("unit").alias("unit")).agg(F.sum("tp").cast("bigint").alias("t"), F.count("*").alias("n"))
    # as confidences of model -1, so that no task has all labels of a class
    counts = labels.groupBy("cls", F.xxhash64("unit").alias("unit")).agg(F.count("*").alias("n"))
    counts = counts.select(F.lit(-1).alias("model"), "cls", F.pmod("unit", F.lit(16)).cast("double").alias("conf"), "unit", F.lit(0).cast("bigint").alias("t"), "n")
    rows = steps.select("model", "cls", F.col("conf").cast("double").alias("conf"), "unit", "t", "n").unionByName(counts)
    sums = rows.repartition("model", "cls", "conf").sortWithinPartitions("model", "cls", "conf")
    sums = sums.mapInPandas(_weigh(rounds), "model int, cls int, conf double, first int, t array<bigint>, n array<bigint>")
    return sums.withColumn("models", F.array(*[F.lit(m) for m in models]).cast("array<int>")).groupBy("cls", "first").applyInPandas(_curves, "model int, cls int, round int, ap double")


def bootstrap_summary(ap: DataFrame, target: float = TARGET) -> DataFrame:
    """Per model, and for the difference of each later model to the first on the same resamples: value of the sample, 95 % limits and the
    chance to be above ``target`` (a difference: above 0), of MEAN_5 and of each class."""
    mean5 = ap.groupBy("model", "round").agg((F.sum(F.when(F.col("cls") >= 1, F.col("ap"))) / 5).alias("value")).select("model", "round", F.lit("MEAN_5").alias("measure"), "value")
    rows = mean5.unionByName(ap.select("model", "round", F.concat(F.lit("class_"), F.col("cls")).alias("measure"), F.col("ap").alias("value")))
    least = rows.agg(F.min("model").alias("base"))
    both = rows.crossJoin(F.broadcast(least))
    base = both.where("model = base").select("round", "measure", F.col("value").alias("before"))
    paired = both.where("model <> base").join(base, ["round", "measure"])
    name = F.concat(F.lit("model_"), F.col("model"))
    all_ = rows.select(name.alias("setting"), "round", "measure", "value", F.lit(float(target)).alias("above"))
    all_ = all_.unionByName(paired.select(F.concat(name, F.lit(" - model_"), F.col("base")).alias("setting"), "round", "measure", (F.col("value") - F.col("before")).alias("value"), F.lit(0.0).alias("above")))
    drawn = F.when(F.col("round") > 0, F.col("value"))
    q = lambda p: F.round(F.percentile(drawn, p), 6)
    return all_.groupBy("setting", "measure").agg(
        F.round(F.max(F.when(F.col("round") == 0, F.col("value"))), 6).alias("value"), q(0.025).alias("low"), q(0.975).alias("high"), F.max("above").alias("above"),
        F.round(F.avg(F.when(F.col("round") > 0, (F.col("value") > F.col("above")).cast("int"))), 6).alias("p_above"), F.count(drawn).alias("rounds"),
    )


def _bootstrap(spark: SparkSession, sf_dir: str, clusters: DataFrame | None = None, rounds: int = ROUNDS, target: float = TARGET) -> DataFrame:
    """Two models over resamples of images, or of ``clusters`` (image, cluster): images of a cluster are drawn together, others by themselves."""
    matched = None
    for model in (0, 1):
        one = _masked(spark, sf_dir, model=model).select("image", "cls", "conf", "tp", F.lit(model).alias("model"))
        matched = one if matched is None else matched.unionByName(one)
    labels = gt_boxes(spark, sf_dir).select("image", "cls")
    if clusters is None:
        matched, labels = (df.withColumn("unit", F.struct(F.lit(0).alias("kind"), F.col("image").cast("bigint").alias("id"))) for df in (matched, labels))
    else:
        unit = F.struct(F.when(F.col("cluster").isNull(), 0).otherwise(1).alias("kind"), F.coalesce("cluster", "image").cast("bigint").alias("id"))
        matched, labels = (df.join(clusters, "image", "left").withColumn("unit", unit) for df in (matched, labels))
    return bootstrap_summary(bootstrap_ap(matched, labels, rounds), target)


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP and MEAN_5 of two models over resamples of the images, and their difference on the same resamples."""
    return _bootstrap(spark, sf_dir)


def bootstrap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with near-duplicate images drawn together; the vector of an image is the one of its number."""
    groups = duplicates.dup_components(spark, sf_dir)
    return _bootstrap(spark, sf_dir, groups.select(F.col("vec_id").alias("image"), F.col("group_id").alias("cluster")))


def precision_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest recall, and the best precision at a recall of at least 0.3."""
    run = Window.partitionBy("cls").orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    steps = _masked(spark, sf_dir).groupBy("cls", "conf").agg(F.sum("tp").alias("t"), F.count("*").alias("n"))
    curve = steps.withColumn("ct", F.sum("t").over(run)).withColumn("cn", F.sum("n").over(run)).join(_totals(spark, sf_dir), "cls")
    return curve.groupBy("cls").agg(F.round(F.max(F.col("ct") / F.col("npos")), 6).alias("max_recall"), F.round(F.max(F.when(F.col("ct") / F.col("npos") >= 0.3, F.col("ct") / F.col("cn"))), 6).alias("precision"))


def rescored_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AP after the confidence is changed by other evidence in three ways."""
    p = (F.col("image") * 31 + F.col("idx")) % 97 / 97
    out = None
    for name, conf in (("product", F.col("conf") * p), ("root", F.col("conf") * F.sqrt(p)), ("plain", F.col("conf"))):
        ap = average_precision(_masked(spark, sf_dir).withColumn("conf", F.round(conf, 9)), _totals(spark, sf_dir), ["cls"]).select(F.lit(name).alias("rule"), "cls", F.round("ap", 6).alias("ap50"))
        out = ap if out is None else out.unionByName(ap)
    return out


def config_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the orders as runs: per clerk group the best price, then the earliest date, then the least key."""
    rows = table(spark, sf_dir, "orders").withColumn("part", F.col("o_custkey") % 10)
    best = rows.groupBy("part").agg(F.max(F.struct("o_totalprice", F.negate(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("d"), (-F.col("o_orderkey")).alias("k"))).alias("b"))
    return best.select("part", (-F.col("b.k")).alias("o_orderkey"), F.round("b.o_totalprice", 2).alias("o_totalprice"))


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model the epochs with the best metric: all of them, the first and the last."""
    order = Window.partitionBy("o_orderpriority", F.col("o_custkey") % 50).orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_custkey") % 50).alias("run"), F.floor(F.col("o_totalprice") / 20000).alias("metric"), F.row_number().over(order).alias("epoch"))
    best = rows.groupBy("o_orderpriority", "run").agg(F.max("metric").alias("best"))
    hits = rows.join(best, ["o_orderpriority", "run"]).where("metric = best")
    return hits.groupBy("o_orderpriority", "run").agg(
        F.max("best").cast("bigint").alias("best"), F.array_join(F.transform(F.array_sort(F.collect_list("epoch")), lambda x: x.cast("string")), ";").alias("epochs"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch")
    )


def _ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average rank of each distinct value, from its count: no row of a tie is ranked by itself."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    bucket = counts.withColumn("_run", F.sum("_n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)))
    return df.join(bucket.select(column, (F.col("_run") - (F.col("_n") - 1) / 2).alias(name)), column)


def spearman_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of quantity, discount and tax of the line items."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("a"), F.round(F.col("l_discount") * 100).cast("int").alias("b"), F.round(F.col("l_tax") * 100).cast("int").alias("c"))
    for column in ("a", "b", "c"):
        rows = _ranked(rows, column, f"r{column}")
    return rows.agg(*[F.round(F.corr(f"r{x}", f"r{y}"), 6).alias(f"rho_{x}{y}") for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])


def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the confidence tells hits from false alarms, from the sums of ranks; and average precision of that."""
    counts = _masked(spark, sf_dir).groupBy("conf").agg(F.sum("tp").alias("p"), F.count("*").alias("n"))
    run = Window.orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    whole = counts.agg(F.sum("p").alias("pos"), (F.sum("n") - F.sum("p")).alias("neg"))
    curve = counts.withColumn("cp", F.sum("p").over(run)).withColumn("cn", F.sum("n").over(run)).crossJoin(F.broadcast(whole))
    # positives above a negative, half of those beside it
    wins = F.sum((F.col("n") - F.col("p")) * (F.col("cp") - F.col("p") / 2))
    return curve.agg(F.round(wins / (F.max("pos") * F.max("neg")), 6).alias("auroc"), F.round(F.sum(F.col("p") / F.col("pos") * F.col("cp") / F.col("cn")), 6).alias("average_precision"))


def histogram_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How unusual boxes are for their class: negative log of smoothed shares of bins of two features, the greatest per class."""
    rows = gt_boxes(spark, sf_dir).select("image", "idx", "cls", F.floor(F.col("w") * 10).alias("b1"), F.floor(F.col("h") * 10).alias("b2"))
    totals = rows.groupBy("cls").agg(F.count("*").alias("n"))
    parts = rows.join(totals, "cls")
    for b in ("b1", "b2"):
        parts = parts.join(rows.groupBy("cls", b).agg(F.count("*").alias(f"n{b}")), ["cls", b])
    nll = F.round(-F.log((F.col("nb1") + 1) / (F.col("n") + 12)) - F.log((F.col("nb2") + 1) / (F.col("n") + 12)), 9)
    return parts.withColumn("nll", nll).groupBy("cls").agg(F.round(F.avg("nll"), 6).alias("mean_nll"), F.round(F.max("nll"), 6).alias("max_nll"), F.count_if(F.col("nll") > 6).alias("n_unusual"))


def linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    y, x = "l_extendedprice", "l_quantity"
    return rows.groupBy("l_returnflag").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


QUERIES = {
    f.__name__: f
    for f in (
        ap101, strict_profile, ap50_95, comparison_table, mean5_gate, two_tier_gate, tau_sweep, bootstrap_rounds, bootstrap_map, precision_at_recall, rescored_ap, config_winner, best_epoch, spearman_scores, auroc, histogram_nll, linear_fit,
        bootstrap_intervals, bootstrap_clusters,
    )
}

_TS = tuple(t / 100 for t in STEPS)
_STEP_TOTALS = f"(SELECT * FROM {_SQL_TOTALS}, (SELECT CAST(unnest([{', '.join(map(str, _TS))}]) AS DOUBLE) AS thr))"


def _sql_profile(model: int = 0) -> str:
    named = ", ".join(f"max(ap) FILTER (thr = {t / 100}) AS ap{t}" for t in (50, 75, 90, 95))
    return f"(SELECT cls, avg(ap) AS ap50_95, {named} FROM {sql_ap(sql_masked(0.5, model, _TS), _STEP_TOTALS, 'cls, thr')} GROUP BY cls)"


_COMPARED = f"""(WITH j AS MATERIALIZED (SELECT a.cls, a.ap50 AS base_ap50, a.ap50_95 AS base_ap50_95, b.ap50 AS new_ap50, b.ap50_95 AS new_ap50_95 FROM {_sql_profile(0)} a JOIN {_sql_profile(1)} b USING (cls))
    SELECT * FROM j UNION ALL SELECT NULL, avg(base_ap50), avg(base_ap50_95), avg(new_ap50), avg(new_ap50_95) FROM j)"""
_FRACTION = "CAST(CAST('0x' || substr(sha256(CAST(image AS VARCHAR) || ':' || CAST(rep AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656"
_TAU_LIST = "(SELECT CAST(unnest([" + ", ".join(map(str, TAUS)) + "]) AS DOUBLE) AS tau)"
_FLAGS = f"(SELECT image, max(conf) AS top FROM {sql_masked()} WHERE cls >= 1 GROUP BY image)"
_P = "((image * 31 + idx) % 97 / 97)"

SQL = {
    "ap101": f"SELECT cls, round(ap, 6) AS ap50 FROM {sql_ap(sql_masked(), _SQL_TOTALS, 'cls')}",
    "strict_profile": f"SELECT cls, round(ap50, 6) AS ap50, round(ap50_95, 6) AS ap50_95, round(ap75, 6) AS ap75, round(ap90, 6) AS ap90, round(ap95, 6) AS ap95, round(ap50 - ap50_95, 6) AS gap FROM {_sql_profile()}",
    "ap50_95": " UNION ALL ".join(f"SELECT {m} AS model, round(avg(ap50), 6) AS map50, round(avg(ap50_95), 6) AS map50_95, round(sum(ap50) FILTER (cls >= 1) / 5, 6) AS mean5 FROM {_sql_profile(m)}" for m in range(4)),
    "comparison_table": f"""SELECT coalesce(CAST(cls AS VARCHAR), 'ALL') AS class, round(base_ap50, 4) AS base_ap50, round(base_ap50_95, 4) AS base_ap50_95, round(new_ap50, 4) AS new_ap50, round(new_ap50_95, 4) AS new_ap50_95,
        round(new_ap50 - base_ap50, 4) AS d_ap50, round(new_ap50_95 - base_ap50_95, 4) AS d_ap50_95 FROM {_COMPARED}""",
    "mean5_gate": f"""WITH c AS MATERIALIZED (SELECT * FROM {_COMPARED}), g AS (SELECT bool_and(new_ap50_95 >= base_ap50_95 - 0.01) FILTER (cls IS NULL) AS global_holds, bool_and(new_ap50 >= base_ap50 + 0.02) FILTER (cls = 4) AS foreign_ap50_gains,
        bool_and(new_ap50_95 >= base_ap50_95 + 0.01) FILTER (cls = 4) AS foreign_ap50_95_gains, bool_and(new_ap50_95 >= base_ap50_95 + 0.01) FILTER (cls = 5) AS strand_ap50_95_gains FROM c)
        SELECT *, global_holds AND foreign_ap50_gains AND foreign_ap50_95_gains AND strand_ap50_95_gains AS candidate_pass FROM g""",
    "two_tier_gate": f"""WITH f AS MATERIALIZED (SELECT DISTINCT image FROM {sql_masked()} WHERE cls >= 1 AND conf >= 0.9), s AS MATERIALIZED (SELECT * FROM (SELECT * FROM {sql_masked(0.5, 1)} WHERE cls <> 4 UNION ALL SELECT * FROM {sql_masked(0.5, 2)} WHERE cls = 4) WHERE image IN (SELECT image FROM f))
        SELECT cls, round(ap, 6) AS ap50 FROM {sql_ap('s', _SQL_TOTALS, 'cls')}""",
    "tau_sweep": f"""WITH f AS MATERIALIZED (SELECT * FROM {_FLAGS}), s AS MATERIALIZED (SELECT m.*, tau FROM {sql_masked(0.5, 1)} m JOIN f USING (image), {_TAU_LIST} WHERE top >= tau), t AS MATERIALIZED (SELECT * FROM {_SQL_TOTALS}, {_TAU_LIST})
        SELECT tau, round((SELECT count(*) FROM f WHERE top >= a.tau) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS sent, round(sum(ap) FILTER (cls >= 1) / 5, 6) AS mean5 FROM {sql_ap('s', 't', 'tau, cls')} a GROUP BY tau""",
    "bootstrap_rounds": f"""WITH m AS MATERIALIZED (SELECT *, CAST({_sql_poisson('u')} AS DOUBLE) AS w FROM (SELECT *, {_FRACTION} AS u FROM {sql_masked()}, range(0, {REPLICATES}) r(rep))),
        t AS MATERIALIZED (SELECT rep, cls, sum({_sql_poisson('u')}) AS npos FROM (SELECT *, {_FRACTION} AS u FROM {SQL_GT}, range(0, {REPLICATES}) r(rep)) GROUP BY rep, cls)
        SELECT rep, cls, round(ap, 6) AS ap50 FROM {sql_ap('m', 't', 'rep, cls', 'w')}""",
    "precision_at_recall": f"""WITH c AS (SELECT cls, sum(t) OVER w AS ct, sum(n) OVER w AS cn, npos FROM (SELECT cls, conf, sum(tp) AS t, count(*) AS n FROM {sql_masked()} GROUP BY cls, conf) JOIN {_SQL_TOTALS} USING (cls) WINDOW w AS (PARTITION BY cls ORDER BY conf DESC ROWS UNBOUNDED PRECEDING))
        SELECT cls, round(max(ct / npos), 6) AS max_recall, round(max(ct / cn) FILTER (ct / npos >= 0.3), 6) AS precision FROM c GROUP BY cls""",
    "rescored_ap": " UNION ALL ".join(
        f"SELECT '{name}' AS rule, cls, round(ap, 6) AS ap50 FROM {sql_ap(f'(SELECT image, idx, cls, tp, round({conf}, 9) AS conf FROM {sql_masked()})', _SQL_TOTALS, 'cls')}" for name, conf in (("product", f"conf * {_P}"), ("root", f"conf * sqrt({_P})"), ("plain", "conf"))
    ),
    "config_winner": "SELECT part, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, o_custkey % 10 AS part, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1",
    "best_epoch": """WITH r AS (SELECT o_orderpriority, o_custkey % 50 AS run, floor(o_totalprice / 20000) AS metric, CAST(row_number() OVER (PARTITION BY o_orderpriority, o_custkey % 50 ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS epoch FROM orders),
        h AS (SELECT * FROM (SELECT *, max(metric) OVER (PARTITION BY o_orderpriority, run) AS best FROM r) WHERE metric = best)
        SELECT o_orderpriority, run, CAST(max(best) AS BIGINT) AS best, string_agg(CAST(epoch AS VARCHAR), ';' ORDER BY epoch) AS epochs, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM h GROUP BY o_orderpriority, run""",
    "spearman_scores": """WITH r AS (SELECT CAST(l_quantity AS INTEGER) AS a, CAST(round(l_discount * 100) AS INTEGER) AS b, CAST(round(l_tax * 100) AS INTEGER) AS c FROM lineitem),
        k AS (SELECT """ + ", ".join(f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 AS r{x}" for x in "abc") + """ FROM r)
        SELECT round(corr(ra, rb), 6) AS rho_ab, round(corr(ra, rc), 6) AS rho_ac, round(corr(rb, rc), 6) AS rho_bc FROM k""",
    "auroc": f"""WITH m AS MATERIALIZED (SELECT conf, tp, rank() OVER (ORDER BY conf) + (count(*) OVER (PARTITION BY conf) - 1) / 2 AS r FROM {sql_masked()}), s AS (SELECT sum(tp) AS p, count(*) - sum(tp) AS n, sum(r) FILTER (tp = 1) AS t FROM m),
        c AS (SELECT conf, sum(tp) AS p, count(*) AS n FROM m GROUP BY conf), d AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM c WINDOW w AS (ORDER BY conf DESC ROWS UNBOUNDED PRECEDING))
        SELECT (SELECT round((t - p * (p + 1) / 2) / (p * n), 6) FROM s) AS auroc, round(sum(p / (SELECT p FROM s) * cp / cn), 6) AS average_precision FROM d""",
    "histogram_nll": f"""WITH r AS MATERIALIZED (SELECT image, idx, cls, floor(w * 10) AS b1, floor(h * 10) AS b2 FROM {SQL_GT}),
        x AS (SELECT cls, round(-ln((count(*) OVER (PARTITION BY cls, b1) + 1) / (count(*) OVER (PARTITION BY cls) + 12)) - ln((count(*) OVER (PARTITION BY cls, b2) + 1) / (count(*) OVER (PARTITION BY cls) + 12)), 9) AS nll FROM r)
        SELECT cls, round(avg(nll), 6) AS mean_nll, round(max(nll), 6) AS max_nll, count(*) FILTER (nll > 6) AS n_unusual FROM x GROUP BY cls""",
    "linear_fit": "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY l_returnflag",
}
