"""Queries of the training-data operators, with their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import normalize as nz
from spanforge.llm.components import connected_components
from spanforge.llm.consensus import consensus_survivors, most_trusted
from spanforge.llm.linkage import link_batches
from spanforge.llm.mixing import Mixer, mix_report
from spanforge.llm.overlap import cross_split
from spanforge.llm.packing import pack_all, pack_checks, pack_report
from spanforge.llm.splits import grouped_split, node, spanning_groups, with_groups
from spanforge.llm.subjects import paragraph_subjects
from spanforge.session import Scratch
from spanforge.sources.tables import table

EVAL = "('val', 'test', 'external_eval')"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of images that look alike, directly or through others."""
    pairs = table(spark, sf_dir, "test_review").where("phash_distance between 0 and 8")
    # 32 bytes instead of 64 digits; bytes and lower-case digits have the same order
    edges = pairs.select(F.unhex(nz.plain_digest(F.col("trainval_sha256"))).alias("a"), F.unhex(nz.plain_digest(F.col("test_sha256"))).alias("b"))
    groups = connected_components(spark, edges)
    return groups.select(F.lower(F.hex("node")).alias("sha256"), F.lower(F.hex("component")).alias("group_sha256"))


P1_SQL = f"""WITH RECURSIVE pair AS (
  SELECT DISTINCT a, b FROM (SELECT {nz.sql_digest('trainval_sha256')} AS a, {nz.sql_digest('test_sha256')} AS b FROM test_review WHERE phash_distance BETWEEN 0 AND 8)
  WHERE a <> b),
edge AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
reach(sha256, other) AS (SELECT a, a FROM edge UNION SELECT r.sha256, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT sha256, min(other) AS group_sha256 FROM reach GROUP BY sha256"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records whose picture is in the training split, too."""
    return cross_split(spark, table(spark, sf_dir, "image_sha256"), with_dataset=False).where("match_kind is not null").select("manifest_index", "match_kind").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and per dataset named in the path."""
    rows = cross_split(spark, table(spark, sf_dir, "image_sha256")).select("manifest_index", "split", "dataset", "match_kind").distinct()
    return rows.groupBy("split", "dataset").agg(
        F.count("*").alias("n_records"), F.count_if(F.col("match_kind") == "exact").alias("n_exact"), F.count_if(F.col("match_kind") == "near").alias("n_near")
    )


_P2_ROWS = f"""SELECT DISTINCT manifest_index, coalesce({nz.sql_split('split')}, {nz.sql_split(nz.sql_path_part('image', 1))}) AS split, {nz.sql_digest('sha256')} AS digest,
    {nz.sql_hash_bits('phash')} AS h, {nz.sql_name(nz.sql_path_part('image', 2))} AS dataset FROM image_sha256"""
_P2_KINDS = f"""WITH r AS MATERIALIZED ({_P2_ROWS}),
train AS MATERIALIZED (SELECT DISTINCT digest, h FROM r WHERE split = 'train'), th AS MATERIALIZED (SELECT DISTINCT h FROM train WHERE h IS NOT NULL),
held AS MATERIALIZED (SELECT *, coalesce(digest IN (SELECT digest FROM train WHERE digest IS NOT NULL), false) AS same FROM r WHERE split IN {EVAL}),
near AS MATERIALIZED (SELECT DISTINCT e.h FROM (SELECT DISTINCT h FROM held WHERE h IS NOT NULL AND NOT same) e JOIN th ON bit_count(xor(e.h, th.h)) <= 4),
kinds AS (SELECT DISTINCT manifest_index, split, dataset, CASE WHEN same THEN 'exact' WHEN h IN (SELECT h FROM near) THEN 'near' END AS match_kind FROM held)"""
P2_SQL = f"{_P2_KINDS} SELECT DISTINCT manifest_index, match_kind FROM kinds WHERE match_kind IS NOT NULL"
P2_REPORT_SQL = f"""{_P2_KINDS} SELECT split, dataset, count(*) AS n_records, count(*) FILTER (match_kind = 'exact') AS n_exact, count(*) FILTER (match_kind = 'near') AS n_near
FROM kinds GROUP BY split, dataset"""

SPLIT_SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


def _audit_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "audit_records")
    source, digest = nz.plain_campaign(F.col("source")), nz.plain_digest(F.col("sha256"))
    # kind 0 sorts first: the least node of a group is its least source, if it has any
    return rows.select("rid", nz.plain_split(F.col("old_split")).alias("old_split"), node(0, source).alias("by_source"), node(1, F.unhex(digest)).alias("by_digest"), "n_boxes", source.alias("plain_source"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of groups that the old splits tear apart."""
    rows = Scratch(spark, "audit").write(_audit_nodes(spark, sf_dir).select("rid", "old_split", "by_source", "by_digest").distinct(), "nodes")
    torn = spanning_groups(spark, rows, ["by_source", "by_digest"], "old_split")
    torn = torn.where(F.hex(F.substring("group", 1, 1)) == "00")
    return torn.select("rid", F.decode(F.expr("substring(group, 2)"), "UTF-8").alias("group_source")).distinct()


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column], DataFrame]:
    """The audit rows with their groups, the labels, and the splits."""
    rows = Scratch(spark, "audit").write(_audit_nodes(spark, sf_dir).distinct(), "nodes")
    # A record whose rows differ in source or digest is a node of its own, so that all its groups are one.
    torn = rows.groupBy("rid").agg(F.count_distinct(F.struct("by_source", "by_digest")).alias("n")).where("n > 1 and rid is not null").select("rid", node(2, F.col("rid").cast("string")).alias("by_record"))
    rows = with_groups(spark, rows.join(torn, "rid", "left"), ["by_source", "by_digest", "by_record"])
    names = [r["dataset"] for r in table(spark, sf_dir, "source_registry").select(nz.plain_name(F.col("dataset")).alias("dataset")).distinct().orderBy("dataset").collect()]
    dataset = F.split_part(F.col("plain_source"), F.lit("/"), F.lit(1))
    labels = {f"dataset:{n}": dataset == n for n in names}
    boxes = F.col("n_boxes")
    labels |= {"boxes:none": boxes == 0, "boxes:one": boxes == 1, "boxes:few": boxes.between(2, 4), "boxes:many": boxes >= 5}
    return rows, labels, grouped_split(spark, rows, "rid", "group", labels, SPLIT_SHARES)


def p3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the audit in train, val or test, groups kept whole."""
    return _split(spark, sf_dir)[2]


def p3_split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each label per split, and their share of all records with the label beside the wanted one."""
    rows, labels, placed = _split(spark, sf_dir)
    held = rows.groupBy("rid").agg(*[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(k) for k, c in labels.items()])
    wanted = F.coalesce(*[F.when(F.col("split") == k, F.lit(v)) for k, v in SPLIT_SHARES.items()])
    counts = held.join(placed, "rid").groupBy("split").agg(*[F.sum(F.col(f"`{k}`")).alias(k) for k in labels])
    long = counts.unpivot("split", [F.col(f"`{k}`") for k in labels], "label", "n_records")
    whole = F.sum("n_records").over(Window.partitionBy("label"))  # three rows a label
    return long.select("split", "label", "n_records", F.round(F.try_divide(F.col("n_records"), whole), 6).alias("share"), wanted.alias("wanted_share"))


def p3_split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records were placed, and how often the rules of the split are broken."""
    rows, _, placed = _split(spark, sf_dir)
    both = rows.select("rid", "by_source", "by_digest").join(placed, "rid")
    parts = [placed.agg(F.lit("records").alias("what"), F.count_distinct("rid").alias("n"))]
    for what, key in (("records_in_two_splits", "rid"), ("sources_in_two_splits", "by_source"), ("digests_in_two_splits", "by_digest")):
        torn = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
        parts.append(torn.agg(F.lit(what).alias("what"), F.count("*").alias("n")))
    counts = placed.agg(*[F.count_if(F.col("split") == k).alias(k) for k in SPLIT_SHARES], F.count("*").alias("all"))
    off = sum(((F.abs(F.col(k) - F.col("all") * v) > 0.02 * F.col("all") + 1).cast("int") for k, v in SPLIT_SHARES.items()), F.lit(0))
    parts.append(counts.select(F.lit("shares_off_by_two_percent").alias("what"), off.cast("bigint").alias("n")))
    return reduce(DataFrame.unionByName, parts)


P3_CHECKS_SQL = """SELECT 'records' AS what, count(DISTINCT rid) AS n FROM audit_records
UNION ALL SELECT unnest(['records_in_two_splits', 'sources_in_two_splits', 'digests_in_two_splits', 'shares_off_by_two_percent']), 0"""


def p3_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the splits have got."""
    rows = p3_split(spark, sf_dir)
    counts = rows.groupBy("split").agg(F.countDistinct("rid").alias("n_records"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n_records").alias("n_all")))).select("split", "n_records", (F.col("n_records") / F.col("n_all")).alias("share"))


P3_SQL = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT DISTINCT rid, {nz.sql_split('old_split')} AS s, {nz.sql_campaign('source')} AS src, {nz.sql_digest('sha256')} AS dig FROM audit_records),
pair AS MATERIALIZED (SELECT DISTINCT '0' || src AS a, '1' || dig AS b FROM r WHERE src IS NOT NULL AND dig IS NOT NULL),
edge AS MATERIALIZED (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
start AS MATERIALIZED (SELECT DISTINCT '0' || src AS n FROM r WHERE src IS NOT NULL UNION SELECT DISTINCT '1' || dig FROM r WHERE dig IS NOT NULL),
low(n, c) USING KEY (n) AS (
  SELECT n, n FROM start
  UNION
  SELECT e.b, min(l.c) FROM low l JOIN edge e ON e.a = l.n JOIN recurring.low k ON k.n = e.b WHERE l.c < k.c GROUP BY e.b),
member AS (SELECT r.rid, r.s, l.c FROM r JOIN low l ON l.n = coalesce('0' || r.src, '1' || r.dig))
SELECT DISTINCT rid, substr(c, 2) AS group_source FROM member
WHERE c IN (SELECT c FROM member GROUP BY c HAVING count(DISTINCT s) >= 2) AND starts_with(c, '0')"""

P6_FIELDS = ("image", "camera", "site", "captured_at")


def _shared_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of digests that several records have, repeated ones too, with the trust in each: greatest is first."""
    images = table(spark, sf_dir, "image_sha256")
    rows = images.select(
        nz.plain_digest(F.col("sha256")).alias("sha256"), "manifest_index", F.nullif(F.trim("image"), F.lit("")).alias("image"), nz.known_text(F.col("camera")).alias("camera"),
        nz.known_text(F.col("site")).alias("site"), F.col("captured_at").cast("string").alias("captured_at"), "updated_at",
    ).where("sha256 is not null")
    several = rows.groupBy("sha256").agg((F.min("manifest_index") < F.max("manifest_index")).alias("several")).where("several").select("sha256")
    rows = rows.join(several, "sha256")
    audit = table(spark, sf_dir, "audit_records").groupBy("rid").agg(F.max_by("source", F.struct("recorded_at", "source")).alias("source"))
    dataset = nz.plain_name(F.split_part(nz.plain_campaign(F.col("source")), F.lit("/"), F.lit(1)))
    audit = audit.select(F.col("rid").alias("manifest_index"), dataset.alias("dataset"))
    registry = table(spark, sf_dir, "source_registry").groupBy(nz.plain_name(F.col("dataset")).alias("dataset")).agg(F.min("trust_rank").alias("trust_rank"))
    trusted = audit.join(registry, "dataset").select("manifest_index", (-F.col("trust_rank")).alias("trust"))
    return rows.join(trusted, "manifest_index", "left").withColumn("early", -F.col("manifest_index"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each shared digest and field, the record whose value survives."""
    rows = _shared_records(spark, sf_dir)
    long = rows.unpivot(["sha256", "trust", "updated_at", "early"], list(P6_FIELDS), "field_name", "value")
    kept = most_trusted(long, ["sha256", "field_name"], "value", ["trust", "updated_at", "early"])
    return kept.select("sha256", "field_name", (-F.col("early")).alias("manifest_index"))


def p6_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that is built for each shared digest."""
    rows = _shared_records(spark, sf_dir)
    long = rows.unpivot(["sha256", "trust", "updated_at", "early"], list(P6_FIELDS), "field_name", "value")
    kept = most_trusted(long, ["sha256", "field_name"], "value", ["trust", "updated_at", "early"])
    return kept.groupBy("sha256").pivot("field_name", list(P6_FIELDS)).agg(F.max("value"))


def p6_consensus(spark: SparkSession, sf_dir: str, half_life_days: float = 180.0) -> DataFrame:
    """The record built for each shared digest by weighted votes: trust (1 / (1 + rank)), recency (half after ``half_life_days``) and completeness
    (known fields of the four) of all its records count, so several agreeing records outvote the most trusted one."""
    rows = _shared_records(spark, sf_dir).distinct()  # a row sent twice votes once
    latest = rows.agg(F.max("updated_at").alias("latest"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    age = F.coalesce((micros("latest") - micros("updated_at")) / F.lit(86400e6), F.lit(4 * half_life_days))
    known = sum((F.col(f).isNotNull().cast("int") for f in P6_FIELDS), F.lit(0))
    vote = F.round(1e6 * F.pow(F.lit(0.5), age / half_life_days) * known / 4 / (1 + F.coalesce(-F.col("trust"), F.lit(100)))).cast("bigint")
    rows = rows.crossJoin(F.broadcast(latest)).withColumn("vote", vote)  # one row
    long = rows.unpivot(["sha256", "trust", "updated_at", "early", "vote"], list(P6_FIELDS), "field_name", "value")
    kept = consensus_survivors(spark, long, ["sha256", "field_name"], "value", ["trust", "updated_at", "early"], weight="vote")
    return kept.groupBy("sha256").pivot("field_name", list(P6_FIELDS)).agg(F.max("value"))


_P6_ROWS = f"""r AS MATERIALIZED (SELECT DISTINCT {nz.sql_digest('sha256')} AS sha256, manifest_index, nullif(trim(image), '') AS image, {nz.sql_known('camera')} AS camera, {nz.sql_known('site')} AS site,
    strftime(captured_at, '%Y-%m-%d %H:%M:%S') AS captured_at, updated_at FROM image_sha256),
shared AS (SELECT sha256 FROM r WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT manifest_index) > 1),
trusted AS (SELECT a.rid, min(g.trust_rank) AS trust_rank FROM (SELECT rid, arg_max(source, recorded_at) AS source FROM audit_records GROUP BY rid) a
    JOIN source_registry g ON g.dataset = {nz.sql_name("split_part(" + nz.sql_campaign('source') + ", '/', 1)")} GROUP BY a.rid),
o AS MATERIALIZED (SELECT r.*, row_number() OVER (PARTITION BY sha256 ORDER BY trust_rank NULLS LAST, updated_at DESC NULLS LAST, manifest_index) AS k
    FROM r JOIN shared USING (sha256) LEFT JOIN trusted t ON t.rid = r.manifest_index)"""
_P6_LONG = "\nUNION ALL ".join(f"SELECT sha256, '{f}' AS field_name, arg_min(manifest_index, k) AS manifest_index, arg_min({f}, k) AS value FROM o WHERE {f} IS NOT NULL GROUP BY sha256" for f in P6_FIELDS)
P6_SQL = f"WITH {_P6_ROWS} SELECT sha256, field_name, manifest_index FROM ({_P6_LONG})"
P6_SURVIVORS_SQL = f"""WITH {_P6_ROWS} SELECT sha256, {', '.join(f"max(value) FILTER (field_name = '{f}') AS {f}" for f in P6_FIELDS)} FROM ({_P6_LONG}) GROUP BY sha256"""

def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r["pack_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_sizes").orderBy("pack_name").collect()}


def _packed(spark: SparkSession, sf_dir: str, apart: tuple = ()) -> tuple[DataFrame, dict[str, int]]:
    sizes = _capacities(spark, sf_dir)
    return pack_all(spark, table(spark, sf_dir, "documents"), sizes, apart=apart), sizes


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text with its pack, for each size of pack."""
    return _packed(spark, sf_dir)[0].select("pack_name", "pack_id", "doc_id", "piece", "n_pieces", "char_start", "char_end", "tokens")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, sizes = _packed(spark, sf_dir)
    parts = [pack_report(packed.where(F.col("pack_name") == name), capacity).withColumn("pack_name", F.lit(name)) for name, capacity in sizes.items()]
    return reduce(DataFrame.unionByName, parts)


#: Sources whose texts the query ``p7_apart`` keeps in different packs.
APART = (("label_review", "tower_radio"), ("field_log", "run_journal"))


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packs of each size against their rules."""
    packed, sizes = _packed(spark, sf_dir)
    return pack_checks(packed, sizes)


def p7_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with two pairs of sources that may not meet in a pack."""
    packed, sizes = _packed(spark, sf_dir, APART)
    return pack_checks(packed, sizes, APART)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose pieces lie in several of the largest packs."""
    packed = pack_all(spark, table(spark, sf_dir, "documents"), {"large": _capacities(spark, sf_dir)["large"]})
    packs = packed.groupBy("doc_id").agg(F.min("pack_id").alias("a"), F.max("pack_id").alias("b"))
    return packs.where("a <> b").select("doc_id")


# Every text is clearly below or clearly above the capacity, so its number of characters decides.
P7_SQL = "SELECT DISTINCT doc_id FROM documents WHERE length(text) > 3 * (SELECT capacity_tokens FROM pack_sizes WHERE pack_name = 'large')"
P7_CHECKS_SQL = """SELECT pack_name, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS n_docs, 0 AS n_overfull, 0 AS n_small_divided, 0 AS n_pieces_lost, 0 AS n_copies_together,
    0 AS n_sources_together, 0 AS n_too_many_packs FROM pack_sizes"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rejected overlay with the accepted earlier ones that it repeats."""
    _, links = link_batches(spark, table(spark, sf_dir, "direct_overlay_manifest"))
    return links.select(F.least("id", "accepted_id").alias("overlay_id_a"), F.greatest("id", "accepted_id").alias("overlay_id_b")).distinct()


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every overlay with the cluster it has ended in."""
    history, _ = link_batches(spark, table(spark, sf_dir, "direct_overlay_manifest"))
    return history.clusters().select(F.col("id").alias("overlay_id"), "cluster_id", "is_representative")


_P5_NAME = "regexp_extract(lower(regexp_extract(replace(source_image, '\\', '/'), '[^/]*$')), '(?:^|[^a-z])([a-z]+_[0-9]{8})(?:[^0-9]|$)', 1)"
_P5_FIELDS = f"""SELECT DISTINCT overlay_id AS id, batch_no AS batch, {nz.sql_digest('source_sha256')} AS digest, nullif(phash_int, 0) AS h, {nz.sql_name('source')} AS dataset, nullif({_P5_NAME}, '') AS file FROM direct_overlay_manifest WHERE overlay_id IS NOT NULL"""
# Row by row over those that match any other: the state holds the accepted rows so far.
P5_SQL = f"""WITH RECURSIVE r AS MATERIALIZED ({_P5_FIELDS}),
pair AS MATERIALIZED (SELECT x.id AS later, x.batch, y.id AS earlier, y.batch AS batch_y FROM r x JOIN r y ON (y.batch, y.id) < (x.batch, x.id)
    AND (x.digest = y.digest OR bit_count(xor(x.h, y.h)) <= 4 OR (x.dataset = y.dataset AND x.file = y.file))),
place AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY batch, id) AS k FROM (SELECT later AS id, batch FROM pair UNION SELECT earlier, batch_y FROM pair)),
before AS MATERIALIZED (SELECT k, id, coalesce(list(earlier) FILTER (earlier IS NOT NULL), []) AS ids FROM place LEFT JOIN pair ON later = id GROUP BY k, id),
walk(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
    SELECT b.k, CASE WHEN list_has_any(w.kept, b.ids) THEN w.kept ELSE list_append(w.kept, b.id) END FROM walk w JOIN before b ON b.k = w.k + 1),
kept AS MATERIALIZED (SELECT unnest(kept) AS id FROM (SELECT kept FROM walk ORDER BY k DESC LIMIT 1))
SELECT DISTINCT least(later, earlier) AS overlay_id_a, greatest(later, earlier) AS overlay_id_b FROM pair WHERE later NOT IN (SELECT id FROM kept) AND earlier IN (SELECT id FROM kept)"""


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r["subject"] for r in table(spark, sf_dir, "subject_areas").select("subject").distinct().orderBy("subject").collect()]
    return paragraph_subjects(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_subject_labels"), names)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that at least one paragraph of a document is mainly about."""
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the corpus is made of."""
    rows = _subjects(spark, sf_dir).groupBy("subject").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_paragraphs"), F.sum("size").alias("n_chars"))
    whole = rows.agg(F.sum("n_chars").alias("all_chars"))
    return rows.crossJoin(F.broadcast(whole)).select("subject", "n_docs", "n_paragraphs", "n_chars", (F.col("n_chars") / F.col("all_chars")).alias("share"))


def _mixes(spark: SparkSession, sf_dir: str):
    targets = table(spark, sf_dir, "mix_targets").select("mix_name", nz.plain_label(F.col("source")).alias("source"), "target_share", "max_repeats").distinct()
    mixer = Mixer(spark, table(spark, sf_dir, "documents"))
    names: dict[str, list] = {}
    for r in targets.orderBy("mix_name", "source").collect():
        names.setdefault(r["mix_name"], []).append(r)
    for name, rows in names.items():
        mixed = mixer.mix({r["source"]: r["target_share"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows})
        yield name, mixed, targets.where(F.col("mix_name") == name).drop("mix_name")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in each mix."""
    out = None
    for name, mixed, _ in _mixes(spark, sf_dir):
        part = mixed.select(F.lit(name).alias("mix_name"), "doc_id", "source", "assumed", "repeats", "tokens")
        out = part if out is None else out.unionByName(part)
    return out


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that the mixes reach."""
    out = None
    for name, mixed, targets in _mixes(spark, sf_dir):
        part = mix_report(mixed, targets).withColumn("mix_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p2_found, p2_report, p3_found, p3_split, p3_split_report, p3_split_labels, p3_split_checks, p6_found, p6_survivors, p6_consensus, p7_found, p7_packs, p7_report, p7_checks, p7_apart,
        p5_found, p5_clusters, p9_found, p9_report, p8_mix, p8_report,
    )
}
SQL = {
    "p1_found": P1_SQL, "p2_found": P2_SQL, "p2_report": P2_REPORT_SQL, "p3_found": P3_SQL, "p3_split_checks": P3_CHECKS_SQL, "p6_found": P6_SQL, "p6_survivors": P6_SURVIVORS_SQL, "p5_found": P5_SQL,
    "p7_found": P7_SQL, "p7_checks": P7_CHECKS_SQL, "p7_apart": P7_CHECKS_SQL,
}
