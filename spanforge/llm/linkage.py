"""Deduplicating new batches against all history: incremental record linkage."""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.normalize import known_bits, plain_digest, plain_name
from spanforge.llm.components import connected_components
from spanforge.llm.overlap import Shingling
from spanforge.session import Scratch, exists

FIELDS = ("digest", "hash", "origin", "dataset")
#: Grades of agreement per field, from 0 (differs) up; for the hash: beyond twice the distance, within that, within the distance, equal.
GRADES = {"digest": 2, "hash": 4, "origin": 2, "dataset": 2}
#: The least grade of a decisive field that makes a match; the dataset alone makes none.
DECISIVE = {"digest": 1, "hash": 2, "origin": 1}
#: The compared fields of a record: the hash itself, and 64-bit digests of the other values.
VALUES = ("h", "dg", "og", "ds")
RECORD = "id bigint, batch bigint, h bigint, dg bigint, og bigint, ds bigint"
KEYS = f"key bigint, {RECORD}, call bigint"
#: Blocks beyond the distance, blocks in a key, and up to how many accepted records these keys are rare enough.
RUNGS = ((2, 2, 2**24), (3, 3, 2**30), (4, 4, 2**62))


def original_file(c: Column) -> Column:
    """The camera's own name in a path: letters, underscore and eight digits, in lower case."""
    name = F.element_at(F.split(F.translate(c, "\\", "/"), "/"), -1)
    return F.nullif(F.regexp_extract(F.lower(name), r"(?:^|[^a-z])([a-z]+_\d{8})(?!\d)", 1), F.lit(""))


def overlay_records(manifest: DataFrame) -> DataFrame:
    """The compared fields of the overlay manifest (see RECORD); a row sent twice counts once (of different rows with one id, the earliest).

    Rows without an id are left out; a missing batch comes last.
    """
    dataset, file = plain_name(F.col("source")), original_file(F.col("source_image"))
    rows = manifest.select(
        F.col("overlay_id").cast("bigint").alias("id"), F.coalesce(F.col("batch_no").cast("bigint"), F.lit(2**62)).alias("batch"), known_bits(F.col("phash_int")).alias("h"),
        plain_digest(F.col("source_sha256")).alias("digest"), dataset.alias("dataset"), file.alias("file"),
    ).where("id is not null")
    coded = rows.select(
        "id", "batch", "h", F.when(F.col("digest").isNotNull(), F.xxhash64("digest")).alias("dg"),
        F.when(F.col("dataset").isNotNull() & F.col("file").isNotNull(), F.xxhash64("dataset", "file")).alias("og"), F.when(F.col("dataset").isNotNull(), F.xxhash64("dataset")).alias("ds"),
    )
    first = coded.groupBy("id").agg(F.min(F.struct("batch", *VALUES)).alias("r"))
    return first.select("id", "r.batch", *[F.col(f"r.{c}").alias(c) for c in VALUES])


class Weights:
    """A weight for each grade of each field, learned from counts of compared pairs, and a threshold.

    A mixture of links and chance pairs is fitted by expectation maximisation, the grades of the
    fields independent in each; a missing field (null) weighs nothing. The weight of a grade is
    log2(m / u), its share among links over that among chance pairs. ``rate`` (0.1) is the least m:
    any field of a link may be wrong that often; ``chance`` (1e-6) the least u, and the most for the grades of
    DECISIVE, which chance pairs reach far less often (so the two kinds can't change places). The threshold is where a pair is as
    likely a link as not. Without pairs the starting shares hold. There are as many patterns as
    combinations of grades (135), whatever the number of pairs.
    """

    START = {"digest": ([0.5, 0.5], [1, 1e-6]), "hash": ([0.3, 0.05, 0.4, 0.25], [0.98, 0.02, 1e-6, 1e-6]), "origin": ([0.5, 0.5], [1, 1e-6]), "dataset": ([0.3, 0.7], [0.9, 0.1])}

    def __init__(self, patterns: Counter, rounds: int = 60, rate: float = 0.1, chance: float = 1e-6, prior: float = 1.0):
        m, u, share = [list(self.START[f][0]) for f in FIELDS], [list(self.START[f][1]) for f in FIELDS], 0.3
        for _ in range(rounds if patterns else 0):
            linked = total = 0.0
            links = [[prior * x for x in self.START[f][0]] for f in FIELDS]
            others = [[prior * x for x in self.START[f][1]] for f in FIELDS]
            for pattern, n in patterns.items():
                a, b = share, 1 - share
                for k, x in enumerate(pattern):
                    if x is not None:
                        a, b = a * m[k][x], b * u[k][x]
                p = a / (a + b)
                linked, total = linked + n * p, total + n
                for k, x in enumerate(pattern):
                    if x is not None:
                        links[k][x] += n * p
                        others[k][x] += n * (1 - p)
            share = min(0.99, max(0.01, linked / total))
            m = [[max(rate, x / sum(s)) for x in s] for s in links]
            u = [[chance if grade >= DECISIVE.get(f, 9) else max(chance, x / sum(s)) for grade, x in enumerate(s)] for f, s in zip(FIELDS, others, strict=True)]
        self.grades = [[math.log2(max(rate, a) / max(chance, b)) for a, b in zip(x, y, strict=True)] for x, y in zip(m, u, strict=True)]
        self.threshold = math.log2((1 - share) / share)

    def score(self, grades: dict[str, Column]) -> Column:
        parts = [F.coalesce(F.get(F.array(*[F.lit(float(w)) for w in self.grades[k]]), grades[f]), F.lit(0.0)) for k, f in enumerate(FIELDS)]
        return reduce(lambda a, b: a + b, parts)


class History:
    """What has been accepted so far: tables in the folder ``path`` that grow with each call of ``ingest``.

    * ``keys-N``: the blocking keys of accepted records with their compared fields, in buckets by key (a probe
      shuffles the new batch, never the history). Keys are the digest, the dataset with the original file, and
      shingles of the perceptual hash: any two of its six blocks of bits, one of which hashes at 4 bits share.
      When the accepted records outgrow that (RUNGS), the table is made anew with longer shingles;
    * ``accepted``: the compared fields of accepted records;
    * ``members``: each rejected record with the accepted one it is tied to; ``roots``: accepted records
      whose cluster has been merged into that of an earlier one, with its root; of several rows the latest counts;
    * ``patterns``: how many compared pairs showed which grades, from which the weights are learned;
    * ``commits``: the calls that ended. Rows of others aren't read, so a call that died left nothing.

    Another session opens the same history by its path. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, distance: int = 4, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.scratch = Scratch(spark, "linkage")
        if exists(spark, f"{self.path}/meta"):
            meta = json.loads(spark.read.text(f"{self.path}/meta").first()[0])
            self.distance, self.buckets = meta["distance"], meta["buckets"]
        else:
            # more buckets than shuffle partitions, else a join would shuffle the history after all
            self.distance, self.buckets = distance, buckets or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
            spark.createDataFrame([(json.dumps({"distance": self.distance, "buckets": self.buckets}),)], "value string").coalesce(1).write.text(f"{self.path}/meta")
        rows = spark.read.schema("call bigint, place int, rung int, n bigint").parquet(f"{self.path}/commits").collect() if exists(spark, f"{self.path}/commits") else []
        self.calls, self.rung, self.size = [r["call"] for r in rows], max((r["rung"] for r in rows), default=0), sum(r["n"] for r in rows)
        self.tables: dict[int, str] = {}

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self.calls or not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("call").isin(self.calls))

    def _append(self, rows: DataFrame, name: str, call: int) -> None:
        rows.withColumn("call", F.lit(call).cast("bigint")).write.mode("append").parquet(f"{self.path}/{name}")

    def accepted(self) -> DataFrame:
        return self._read("accepted", RECORD + ", call bigint").drop("call")

    def members(self) -> DataFrame:
        return self._read("members", "id bigint, parent bigint, call bigint").drop("call")

    @property
    def shingling(self) -> Shingling:
        extra, width, _ = RUNGS[self.rung]
        return Shingling(self.distance + extra, width, self.distance)

    def _table(self) -> str:
        """The key table as one with buckets, whose files lie in the folder."""
        if self.rung not in self.tables:
            name = f"linkage_{uuid.uuid4().hex}"
            columns = ", ".join(KEYS.split(", "))
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/keys-{self.rung}'")
            self.tables[self.rung] = name
        return self.tables[self.rung]

    def _key_rows(self, records: DataFrame) -> DataFrame:
        """One row per blocking key of each record, with the record's fields."""
        h = F.col("h")
        keys = [F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(i), c)) for i, c in enumerate(("dg", "og"))]
        keys += [F.when(h.isNotNull(), F.xxhash64(F.lit(2), self.shingling.shingle(h, i))) for i in range(self.shingling.size)]
        return records.select(F.explode(F.array_compact(F.array(*keys))).alias("key"), "id", "batch", *VALUES)

    def _store_keys(self, records: DataFrame, call: int) -> None:
        rows = self._key_rows(records).withColumn("call", F.lit(call).cast("bigint")).repartition(self.buckets, "key")
        rows.select(*[c.split()[0] for c in KEYS.split(", ")]).write.insertInto(self._table())

    def _grow(self, more: int) -> None:
        """Longer shingles, once the accepted records outgrow those in use."""
        rung = self.rung
        while self.size + more > RUNGS[rung][2]:
            rung += 1
        if rung > self.rung:
            old, self.rung = self.accepted(), rung
            token = uuid.uuid4().int >> 66
            self._store_keys(old, token)
            self._commit(token, 0)

    def _commit(self, call: int, n: int) -> None:
        self.spark.createDataFrame([(call, len(self.calls), self.rung, n)], "call bigint, place int, rung int, n bigint").coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self.calls.append(call)
        self.size += n

    def _grades(self, a: str, b: str) -> dict[str, Column]:
        x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
        far = F.bit_count(x("h").bitwiseXOR(y("h")))
        hash_ = F.when(far == 0, 3).when(far <= self.distance, 2).when(far <= 2 * self.distance, 1).when(far.isNotNull(), 0)
        out = {"hash": hash_} | {f: (x(c) == y(c)).cast("int") for f, c in (("digest", "dg"), ("origin", "og"), ("dataset", "ds"))}
        return {f: out[f].alias(f"g_{f}") for f in FIELDS}

    def _compared(self, a: str, b: str) -> list[Column]:
        return list(self._grades(a, b).values())

    @staticmethod
    def _linked(weights: Weights) -> tuple[Column, Column]:
        """The score of compared pairs; and whether they are linked: a score that reaches the threshold, and the exact check after it."""
        grades = {f: F.col(f"g_{f}") for f in FIELDS}
        score = weights.score(grades)
        exact = reduce(lambda p, q: p | q, [F.coalesce(grades[f] >= least, F.lit(False)) for f, least in DECISIVE.items()])
        return score, (score >= F.lit(weights.threshold - 1e-9)) & exact

    def _learn(self, compared: list[DataFrame], call: int) -> Weights:
        names = [f"g_{f}" for f in FIELDS]
        seen = reduce(DataFrame.unionByName, [c.select("id", "other", *names) for c in compared]).where("id <> other").distinct()
        schema = ", ".join(f"{n} int" for n in names) + ", n bigint, call bigint"
        now = seen.groupBy(*names).agg(F.count("*").alias("n")).collect()
        patterns: Counter = Counter()
        for r in [*now, *self._read("patterns", schema).groupBy(*names).agg(F.sum("n").alias("n")).collect()]:
            patterns[tuple(r[n] for n in names)] += r["n"]
        if now:
            self._append(self.spark.createDataFrame([tuple(r) for r in now], schema.removesuffix(", call bigint")).coalesce(1), "patterns", call)
        return Weights(patterns)

    def ingest(self, records: DataFrame) -> DataFrame:
        """Accept or reject new ``records`` (see RECORD) in the order of batch and id; the links of those rejected.

        A record is rejected if it is linked to one accepted before, in earlier calls or in this one. Candidates
        share a blocking key. They are compared field by field, the learned weights score them, and a
        score below the threshold ends a pair; an exact check of the decisive fields follows. Keys that no
        other record has leave first. Among the new records, rounds decide: a record that comes first under each of its
        shared keys is linked to no earlier open record, so it is accepted, and the open
        records linked to it are rejected, until none is open. Each record is only compared with the
        first one under a key, and with accepted ones, so keys that many records share stay linear.

        The result (id, accepted_id, score) has one row for each accepted record that a
        rejected one is linked to. Clusters are brought up to date. Records without any key are accepted; missing fields match
        nothing; an empty table changes nothing; other columns aren't read. Ids must be new: the caller drops rows sent twice (see overlay_records).
        """
        scratch, call = self.scratch, uuid.uuid4().int >> 66
        new = scratch.write(records.select("id", "batch", *VALUES), "records")
        n_new = new.count()
        self._grow(n_new)
        keys = self._key_rows(new)
        counts = keys.groupBy("key").count()
        shared = counts.where("count > 1").select("key")
        old = None
        if self.calls:
            stored = self.spark.table(self._table()).where(F.col("call").isin(self.calls)).drop("call")
            old = scratch.write(stored.join(counts.select("key"), "key", "left_semi"), "met")
            shared = shared.unionByName(old.select("key")).distinct()
        mine = scratch.write(keys.join(shared, "key", "left_semi"), "keys")

        inside = scratch.write(self._with_first(mine), "round")
        across = None
        if old is not None:
            pairs = mine.alias("x").join(old.alias("y"), "key").select(F.col("x.id").alias("id"), F.col("y.id").alias("other"), *self._compared("x", "y"))
            across = scratch.write(pairs, "across")
        weights = self._learn([inside] + ([across] if across is not None else []), call)
        score, linked = self._linked(weights)

        gone = []
        links = []
        if across is not None:
            links.append(across.where(linked).select("id", F.col("other").alias("accepted_id"), score.alias("score")))
            gone.append(scratch.write(links[0].select("id").distinct(), "gone"))
            inside = scratch.write(self._with_first(self._rows_of(inside).join(gone[0], "id", "left_anti")), "round")
        while not inside.isEmpty():
            marked = inside.withColumn("linked", linked & (F.col("id") != F.col("other")))
            pivots = marked.groupBy("id").agg(F.bool_and(F.col("id") == F.col("other")).alias("p")).where("p").select("id")
            hit = marked.where("linked").join(pivots.select(F.col("id").alias("other")), "other", "left_semi").select("id").distinct()
            settled = scratch.write(pivots.withColumn("hit", F.lit(False)).unionByName(hit.withColumn("hit", F.lit(True))), "settled")
            gone.append(settled.where("hit").select("id"))
            after = scratch.write(self._with_first(self._rows_of(inside).join(settled, "id", "left_anti")), "round")
            scratch.drop(inside)
            inside = after
        rejected = reduce(DataFrame.unionByName, gone).distinct() if gone else self.spark.createDataFrame([], "id bigint")
        rejected = scratch.write(rejected, "rejected")

        late, kept = mine.join(rejected, "id", "left_semi").alias("x"), mine.join(rejected, "id", "left_anti").alias("y")
        earlier = F.struct("y.batch", "y.id") < F.struct("x.batch", "x.id")
        within = late.join(kept, (F.col("x.key") == F.col("y.key")) & earlier).select(F.col("x.id").alias("id"), F.col("y.id").alias("other"), *self._compared("x", "y"))
        links.append(within.where(linked).select("id", F.col("other").alias("accepted_id"), score.alias("score")))
        found = scratch.write(reduce(DataFrame.unionByName, links).groupBy("id", "accepted_id").agg(F.max("score").alias("score")), "links")

        accepted = new.join(rejected, "id", "left_anti")
        self._store_keys(accepted, call)
        self._append(accepted, "accepted", call)
        self._update_clusters(found, call)
        if n_new:
            self._commit(call, n_new - rejected.count())
        scratch.drop(mine, old, across, inside, *gone[:1])
        return found

    def _with_first(self, rows: DataFrame) -> DataFrame:
        """Rows of keys that several records have, each compared with the first record of its key."""
        first = rows.groupBy("key").agg(F.min(F.struct("batch", "id", *VALUES)).alias("f"), F.count("*").alias("n")).where("n > 1").select("key", "f.*")
        return rows.alias("x").join(first.alias("y"), "key").select("key", *[F.col(f"x.{c}").alias(c) for c in ("id", "batch", *VALUES)], F.col("y.id").alias("other"), *self._compared("x", "y"))

    @staticmethod
    def _rows_of(compared: DataFrame) -> DataFrame:
        return compared.select("key", "id", "batch", *VALUES)

    def _update_clusters(self, links: DataFrame, call: int) -> None:
        """Tie rejected records to representatives, and merge the clusters that they bridge.

        Only clusters that ``links`` touch change: the representative of a rejected record is its earliest accepted
        match; further matches merge roots of the union-find table, whose pointers go to the root at once.
        """
        first = links.groupBy("id").agg(F.min("accepted_id").alias("parent"))
        self._append(first, "members", call)
        bridges = self.scratch.write(links.join(first, "id").where("accepted_id <> parent").select(F.col("accepted_id").alias("a"), F.col("parent").alias("b")).distinct(), "bridges")
        if bridges.isEmpty():
            return
        ends = self.roots(bridges.select(F.col("a").alias("id")).unionByName(bridges.select(F.col("b").alias("id"))).distinct())
        ends = self.scratch.write(ends, "ends")
        joined = bridges.join(ends.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a").join(ends.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b")
        merged = connected_components(self.spark, joined, "ra", "rb").where("node <> component").select(F.col("node").alias("root"), F.col("component").alias("to"))
        merged = self.scratch.write(merged, "merged")
        pointing = self._pointers().join(merged, "root").select("id", F.col("to").alias("root"))
        moved = pointing.unionByName(merged.select(F.col("root").alias("id"), F.col("to").alias("root")))
        self._append(moved.withColumn("place", F.lit(len(self.calls))), "roots", call)

    def _pointers(self) -> DataFrame:
        rows = self._read("roots", "id bigint, root bigint, place int, call bigint")
        return rows.groupBy("id").agg(F.max_by("root", "place").alias("root"))

    def roots(self, ids: DataFrame) -> DataFrame:
        """(id, root) of accepted records: the pointer of the union-find table, or the record itself."""
        return ids.join(self._pointers(), "id", "left").select("id", F.coalesce("root", "id").alias("root"))

    def clusters(self) -> DataFrame:
        """(id, cluster_id, is_representative) of every record that was ever given to ``ingest``."""
        accepted = self.roots(self.accepted().select("id"))
        tied = self.members().select(F.col("id").alias("member"), F.col("parent").alias("id")).join(accepted, "id")
        out = accepted.select("id", F.col("root").alias("cluster_id"), (F.col("id") == F.col("root")).alias("is_representative"))
        return out.unionByName(tied.select(F.col("member").alias("id"), F.col("root").alias("cluster_id"), F.lit(False).alias("is_representative")))


def link_batches(spark: SparkSession, manifest: DataFrame, batches_per_call: int = 10, path: str | None = None) -> tuple[History, DataFrame]:
    """Feed the manifest to the history in ``path`` (a new one, if none is given), ``batches_per_call`` batches at a time; all links found.

    The links don't depend on how many batches a call takes. The numbers of the batches are the only rows the driver sees.
    """
    scratch = Scratch(spark, "overlays")
    history = History(spark, path or f"{scratch.root}/history")
    records = scratch.write(overlay_records(manifest), "manifest")
    numbers = sorted(r[0] for r in records.select("batch").distinct().collect())
    found = []
    for at in range(0, len(numbers), batches_per_call):
        found.append(history.ingest(records.where(F.col("batch").between(numbers[at], numbers[min(at + batches_per_call, len(numbers)) - 1]))))
    empty = spark.createDataFrame([], "id bigint, accepted_id bigint, score double")
    return history, reduce(DataFrame.unionByName, found) if found else empty
