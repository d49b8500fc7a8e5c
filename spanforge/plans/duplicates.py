"""Leakage and duplicates over the image list and the vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import dedup
from spanforge.sources.fixtures import SQL_MANIFEST, manifest, sign_hashes, sql_signs
from spanforge.sources.tables import table

BITS, NEAR, STRONG_COSINE, REVIEW_NEAR, REVIEW_COSINE = 24, 4, 0.35, 6, 0.20
SECOND_NEAR = 6
QUERY_STEP = 20


def exact_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split: records whose digest a training record has, and pairs of such records."""
    rows = manifest(spark, sf_dir).where("digest is not null")
    train = rows.where("split = 'train'").groupBy("digest").agg(F.count("*").alias("n"))
    hits = rows.where("split <> 'train'").join(train, "digest")
    return hits.groupBy("split").agg(F.count("*").alias("n_leaked"), F.sum("n").alias("n_pairs"))


def cross_split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests in more than one split."""
    rows = manifest(spark, sf_dir).where("digest is not null and split is not null")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n_images"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits"), F.countDistinct("split").alias("n"))
    return groups.where("n > 1").select("digest", "n_images", "splits")


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per digest, the first path; how many fell together."""
    rows = manifest(spark, sf_dir).where("digest is not null").select("image", "path", "digest", "split")
    return dedup.first_of_group(rows, "digest", [F.col("path"), F.col("image")]).select("image", "digest", "split", "n_rows")


def dedup_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests whose records disagree on their size."""
    groups = manifest(spark, sf_dir).where("digest is not null").groupBy("digest").agg(F.count("*").alias("n_rows"), F.countDistinct(F.struct("width", "height")).alias("n_sizes"))
    return groups.where("n_sizes > 1")


def dedup_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per digest: training before others, then the dataset and path that sort first."""
    rows = manifest(spark, sf_dir).where("digest is not null").select("image", "path", "digest", "split", "dataset")
    order = [F.when(F.col("split") == "train", 0).otherwise(1), F.coalesce("dataset", F.lit("~")), F.col("path"), F.col("image")]
    return dedup.first_of_group(rows, "digest", order).select("image", "digest", "split", "dataset", "n_rows")


def quarantine_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External images that repeat an earlier one of their own, or else one of the base set."""
    rows = manifest(spark, sf_dir).where("digest is not null").select("image", "digest", "split")
    outside = rows.where("split = 'external_eval'")
    first = outside.groupBy("digest").agg(F.min("image").alias("first"))
    base = rows.where("split <> 'external_eval'").select("digest").distinct().withColumn("in_base", F.lit(True))
    marked = outside.join(first, "digest").join(base, "digest", "left")
    reason = F.when(F.col("image") > F.col("first"), "duplicate_within").when(F.col("in_base"), "duplicate_of_base")
    return marked.withColumn("reason", reason).where("reason is not null").select("image", "reason")


def _pairs(spark: SparkSession, sf_dir: str, distance: int = NEAR, first: int = 0) -> DataFrame:
    rows = sign_hashes(spark, sf_dir, first, BITS)
    left = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea"), "hash")
    right = rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"), "hash")
    return dedup.hamming_join(left, right, distance, BITS).where("a < b").withColumn("cosine", dedup.cosine("ea", "eb"))


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", "hamming")


def _split(c: str) -> Column:
    """Splits of the vectors, by a digest of their number."""
    share = F.conv(F.substring(F.sha2(F.col(c).cast("string"), 256), 1, 12), 16, 10).cast("double") / F.lit(281474976710656.0)
    return F.when(share < 0.8, "train").when(share < 0.9, "val").otherwise("test")


def _sql_split(c: str) -> str:
    share = f"CAST(CAST('0x' || substr(sha256(CAST({c} AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656"
    return f"CASE WHEN {share} < 0.8 THEN 'train' WHEN {share} < 0.9 THEN 'val' ELSE 'test' END"


def near_dup_vs_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training vectors near one of the evaluation splits: candidates for review."""
    rows = sign_hashes(spark, sf_dir, 0, BITS).withColumn("split", _split("vec_id"))
    left = rows.where("split = 'train'").select(F.col("vec_id").alias("candidate"), "hash")
    right = rows.where("split <> 'train'").select(F.col("vec_id").alias("base"), F.col("split").alias("base_split"), "hash")
    return dedup.hamming_join(left, right, NEAR, BITS).select("candidate", "base", "base_split", "hamming")


def leak_edges_of(rows: DataFrame) -> DataFrame:
    """(a, b, h1, h2, cosine, kind) of pairs of ``rows`` (vec_id, hash, second, embedding) that are near by one of two hashes.

    Strong: near by the first and by the second hash, with a high cosine; else for review if the cosine is fair. Both distances
    are computed for every pair; pairs that the first hash finds aren't taken again from the second.
    """
    side = lambda v, e, s: rows.select(F.col("vec_id").alias(v), F.col("embedding").alias(e), F.col("hash").alias(f"{s}1"), F.col("second").alias(f"{s}2"))
    left, right = side("a", "ea", "x"), side("b", "eb", "y")
    found = [dedup.hamming_join(left.withColumn("hash", F.col(f"x{k}")), right.withColumn("hash", F.col(f"y{k}")), REVIEW_NEAR, BITS).where("a < b").drop("hamming") for k in (1, 2)]
    h1, h2 = (F.bit_count(F.col(f"x{k}").bitwiseXOR(F.col(f"y{k}"))).cast("int") for k in (1, 2))
    both = found[0].unionByName(found[1].where(h1 > REVIEW_NEAR)).select("a", "b", h1.alias("h1"), h2.alias("h2"), dedup.cosine("ea", "eb").alias("cosine"))
    strong = (F.col("h1") <= NEAR) & (F.col("h2") <= SECOND_NEAR) & (F.col("cosine") >= STRONG_COSINE)
    return both.withColumn("kind", F.when(strong, "strong").when(F.col("cosine") >= REVIEW_COSINE, "review")).where("kind is not null")


def _leak_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = sign_hashes(spark, sf_dir, BITS, BITS).select("vec_id", F.col("hash").alias("second"))
    return leak_edges_of(sign_hashes(spark, sf_dir, 0, BITS).join(second, "vec_id"))


def strong_review_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leak_edges(spark, sf_dir).select("a", "b", "kind", F.round("cosine", 6).alias("cosine"))


def leak_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges with both distances."""
    return _leak_edges(spark, sf_dir).select("a", "b", "h1", "h2", "kind", F.round("cosine", 6).alias("cosine"))


def leak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the strong edges of ``leak_edges``."""
    groups = dedup.components(spark, _leak_edges(spark, sf_dir).where("kind = 'strong'").select("a", "b"), "a", "b")
    return groups.select(F.col("node").alias("vec_id"), F.col("component").alias("group_id"))


def leak_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members outside test of components of strong edges that hold a test vector."""
    return _touching_test(leak_components(spark, sf_dir))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = dedup.components(spark, _pairs(spark, sf_dir).select("a", "b"), "a", "b")
    return groups.select(F.col("node").alias("vec_id"), F.col("component").alias("group_id"))


def dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir)


def quarantine_test_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members outside test of groups that hold a test vector."""
    return _touching_test(_members(spark, sf_dir))


def _touching_test(members: DataFrame) -> DataFrame:
    rows = members.withColumn("split", _split("vec_id"))
    touched = rows.groupBy("group_id").agg(F.bool_or(F.col("split") == "test").alias("t")).where("t").select("group_id")
    return rows.where("split <> 'test'").join(touched, "group_id", "left_semi").select("vec_id", "group_id", "split")


def review_pairs_on_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs with exactly one end in test."""
    rows = _pairs(spark, sf_dir).withColumn("sa", _split("a")).withColumn("sb", _split("b"))
    return rows.where((F.col("sa") == "test") != (F.col("sb") == "test")).select("a", "b", "hamming")


def drop_later_or_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation vectors to drop: near an earlier evaluation vector, or near any training vector."""
    rows = _pairs(spark, sf_dir).withColumn("sa", _split("a")).withColumn("sb", _split("b"))
    within = dedup.drop_later(rows.where("sa <> 'train' and sb <> 'train'"), "a", "b")
    known = rows.where("sa = 'train' and sb <> 'train'").select(F.col("b").alias("dropped")).unionByName(rows.where("sa <> 'train' and sb = 'train'").select(F.col("a").alias("dropped")))
    return within.unionByName(known).distinct()


def external_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First the test vectors near a training vector go; then the validation vectors near a test vector that is left."""
    rows = _pairs(spark, sf_dir).withColumn("sa", _split("a")).withColumn("sb", _split("b"))
    both = rows.select(F.col("a").alias("x"), F.col("sa").alias("sx"), F.col("b").alias("y"), F.col("sb").alias("sy"))
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("sy").alias("sx"), F.col("x").alias("y"), F.col("sx").alias("sy")))
    one = both.where("sx = 'test' and sy = 'train'").select("x").distinct()
    two = both.where("sx = 'val' and sy = 'test'").join(one.select(F.col("x").alias("y")), "y", "left_anti").select("x").distinct()
    return one.withColumn("pass", F.lit(1)).unionByName(two.withColumn("pass", F.lit(2))).withColumnRenamed("x", "vec_id")


def nearest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every 20th vector the nearest other hash (ties: the least number)."""
    rows = sign_hashes(spark, sf_dir, 0, BITS).select("vec_id", "hash")
    queries = rows.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query"), F.col("hash").alias("hq"))
    # a stated set of queries against all rows
    pairs = rows.join(F.broadcast(queries), F.col("vec_id") != F.col("query"))
    best = pairs.groupBy("query").agg(F.min(F.struct(F.bit_count(F.col("hash").bitwiseXOR(F.col("hq"))).alias("d"), F.col("vec_id").alias("v"))).alias("m"))
    return best.select("query", F.col("m.v").alias("nearest"), F.col("m.d").cast("int").alias("hamming"))


def overlay_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations: file names of the overlay manifest by source split, in one, both or either."""
    rows = table(spark, sf_dir, "direct_overlay_manifest")
    a = rows.where("source_split = 'train'").select("source_image")
    b = rows.where("source_split = 'all'").select("source_image")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "only_train": a.subtract(b), "only_all": b.subtract(a)}
    out = None
    for name, part in parts.items():
        one = part.agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_SQL_COS = "list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _sql_pairs(distance: int = NEAR, first: int = 0) -> str:
    rows = sql_signs(first, BITS)
    return f"(SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS hamming, {_SQL_COS} AS cosine FROM {rows} x JOIN {rows} y ON x.vec_id < y.vec_id AND bit_count(xor(x.hash, y.hash)) <= {distance})"


_SQL_MEMBERS = f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a, b FROM {_sql_pairs()}), e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach(n, m) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM reach r JOIN e ON e.a = r.m),
members AS (SELECT n AS vec_id, min(m) AS group_id FROM reach GROUP BY n)"""
_SQL_SPLIT_PAIRS = f"(SELECT *, {_sql_split('a')} AS sa, {_sql_split('b')} AS sb FROM {_sql_pairs()})"

_SQL_LEAK = f"""(SELECT a, b, h1, h2, cosine, CASE WHEN h1 <= {NEAR} AND h2 <= {SECOND_NEAR} AND cosine >= {STRONG_COSINE} THEN 'strong' ELSE 'review' END AS kind
    FROM (SELECT x.vec_id AS a, y.vec_id AS b, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS h1, CAST(bit_count(xor(x2.hash, y2.hash)) AS INTEGER) AS h2, {_SQL_COS} AS cosine
      FROM {sql_signs(0, BITS)} x JOIN {sql_signs(BITS, BITS)} x2 ON x2.vec_id = x.vec_id, {sql_signs(0, BITS)} y JOIN {sql_signs(BITS, BITS)} y2 ON y2.vec_id = y.vec_id
      WHERE x.vec_id < y.vec_id AND (bit_count(xor(x.hash, y.hash)) <= {REVIEW_NEAR} OR bit_count(xor(x2.hash, y2.hash)) <= {REVIEW_NEAR}))
    WHERE (h1 <= {NEAR} AND h2 <= {SECOND_NEAR} AND cosine >= {STRONG_COSINE}) OR cosine >= {REVIEW_COSINE})"""
_SQL_LEAK_MEMBERS = _SQL_MEMBERS.replace(_sql_pairs(), f"(SELECT a, b FROM {_SQL_LEAK} WHERE kind = 'strong')")

QUERIES = {
    f.__name__: f
    for f in (
        exact_leakage, cross_split_groups, dedup_first_wins, dedup_conflicts, dedup_preference, quarantine_reason, near_dup_pairs, near_dup_vs_reference, strong_review_edges,
        dup_components, quarantine_test_touching, review_pairs_on_test, drop_later_or_known, external_two_pass, nearest_hash, overlay_sets,
        leak_edges, leak_components, leak_quarantine,
    )
}

SQL = {
    "exact_leakage": f"""WITH m AS (SELECT * FROM {SQL_MANIFEST} WHERE digest IS NOT NULL)
        SELECT e.split, count(DISTINCT e.image) AS n_leaked, count(*) AS n_pairs FROM m e JOIN m t ON t.digest = e.digest AND t.split = 'train' WHERE e.split <> 'train' GROUP BY e.split""",
    "cross_split_groups": f"""SELECT digest, count(*) AS n_images, string_agg(DISTINCT split, ',' ORDER BY split) AS splits FROM {SQL_MANIFEST} WHERE digest IS NOT NULL AND split IS NOT NULL
        GROUP BY digest HAVING count(DISTINCT split) > 1""",
    "dedup_first_wins": f"SELECT image, digest, split, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY path, image) AS k, count(*) OVER (PARTITION BY digest) AS n_rows FROM {SQL_MANIFEST} WHERE digest IS NOT NULL) WHERE k = 1",
    "dedup_conflicts": f"SELECT digest, count(*) AS n_rows, count(DISTINCT (width, height)) AS n_sizes FROM {SQL_MANIFEST} WHERE digest IS NOT NULL GROUP BY digest HAVING n_sizes > 1",
    "dedup_preference": f"""SELECT image, digest, split, dataset, n_rows FROM (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY CASE WHEN split = 'train' THEN 0 ELSE 1 END, coalesce(dataset, '~'), path, image) AS k,
        count(*) OVER (PARTITION BY digest) AS n_rows FROM {SQL_MANIFEST} WHERE digest IS NOT NULL) WHERE k = 1""",
    "quarantine_reason": f"""WITH m AS MATERIALIZED (SELECT image, digest, split FROM {SQL_MANIFEST} WHERE digest IS NOT NULL), o AS (SELECT *, min(image) OVER (PARTITION BY digest) AS first FROM m WHERE split = 'external_eval')
        SELECT image, CASE WHEN image > first THEN 'duplicate_within' ELSE 'duplicate_of_base' END AS reason FROM o WHERE image > first OR digest IN (SELECT digest FROM m WHERE split <> 'external_eval')""",
    "near_dup_pairs": f"SELECT a, b, hamming FROM {_sql_pairs()}",
    "near_dup_vs_reference": f"""WITH v AS MATERIALIZED (SELECT *, {_sql_split('vec_id')} AS split FROM {sql_signs(0, BITS)})
        SELECT x.vec_id AS candidate, y.vec_id AS base, y.split AS base_split, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS hamming FROM v x JOIN v y ON bit_count(xor(x.hash, y.hash)) <= {NEAR}
        WHERE x.split = 'train' AND y.split <> 'train'""",
    "strong_review_edges": f"SELECT a, b, kind, round(cosine, 6) AS cosine FROM {_SQL_LEAK}",
    "leak_edges": f"SELECT a, b, h1, h2, kind, round(cosine, 6) AS cosine FROM {_SQL_LEAK}",
    "leak_components": f"{_SQL_LEAK_MEMBERS} SELECT * FROM members",
    "leak_quarantine": f"""{_SQL_LEAK_MEMBERS}, s AS (SELECT *, {_sql_split('vec_id')} AS split FROM members)
        SELECT vec_id, group_id, split FROM s WHERE split <> 'test' AND group_id IN (SELECT group_id FROM s WHERE split = 'test')""",
    "dup_components": f"{_SQL_MEMBERS} SELECT * FROM members",
    "quarantine_test_touching": f"""{_SQL_MEMBERS}, s AS (SELECT *, {_sql_split('vec_id')} AS split FROM members)
        SELECT vec_id, group_id, split FROM s WHERE split <> 'test' AND group_id IN (SELECT group_id FROM s WHERE split = 'test')""",
    "review_pairs_on_test": f"SELECT a, b, hamming FROM {_SQL_SPLIT_PAIRS} WHERE (sa = 'test') <> (sb = 'test')",
    "drop_later_or_known": f"""WITH p AS MATERIALIZED (SELECT * FROM {_SQL_SPLIT_PAIRS}) SELECT b AS dropped FROM p WHERE sb <> 'train' UNION SELECT a FROM p WHERE sa <> 'train' AND sb = 'train'""",
    "external_two_pass": f"""WITH p AS MATERIALIZED (SELECT * FROM {_SQL_SPLIT_PAIRS}), d AS (SELECT a AS x, sa AS sx, b AS y, sb AS sy FROM p UNION ALL SELECT b, sb, a, sa FROM p),
        one AS (SELECT DISTINCT x FROM d WHERE sx = 'test' AND sy = 'train')
        SELECT x AS vec_id, 1 AS pass FROM one UNION ALL SELECT DISTINCT x, 2 FROM d WHERE sx = 'val' AND sy = 'test' AND y NOT IN (SELECT x FROM one)""",
    "nearest_hash": f"""WITH v AS MATERIALIZED (SELECT * FROM {sql_signs(0, BITS)})
        SELECT query, nearest, hamming FROM (SELECT q.vec_id AS query, v.vec_id AS nearest, CAST(bit_count(xor(q.hash, v.hash)) AS INTEGER) AS hamming,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.hash, v.hash)), v.vec_id) AS k FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % {QUERY_STEP} = 0) WHERE k = 1""",
    "overlay_sets": """WITH a AS (SELECT DISTINCT source_image AS f FROM direct_overlay_manifest WHERE source_split = 'train'), b AS (SELECT DISTINCT source_image AS f FROM direct_overlay_manifest WHERE source_split = 'all')
        SELECT 'union' AS operation, count(*) AS n FROM (SELECT f FROM a UNION SELECT f FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT f FROM a INTERSECT SELECT f FROM b)
        UNION ALL SELECT 'only_train', count(*) FROM (SELECT f FROM a EXCEPT SELECT f FROM b) UNION ALL SELECT 'only_all', count(*) FROM (SELECT f FROM b EXCEPT SELECT f FROM a)""",
}
