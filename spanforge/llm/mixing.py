"""Mixing sources to target weights: soft membership and projected-gradient rates."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions.normalize import plain_label
from spanforge.llm.tokens import TOKENIZER, encoding
from spanforge.session import Scratch

_PART = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|\n")
_FEATURES = 1 << 14
_LEVEL = 1024


def features(text: str) -> np.ndarray:
    """Hashed words, marks and line ends that a text holds, figures as one."""
    found = {"9" if p.isdigit() else p for p in _PART.findall(text.lower())}
    return np.unique(np.fromiter((crc32(p.encode()) % _FEATURES for p in found), np.int64, len(found)))


@dataclass
class Domains:
    """A naive Bayes classifier of texts by source, fitted on rows whose source is known."""

    names: list[str]
    prior: np.ndarray
    likelihood: np.ndarray  # log odds-free likelihoods: domain x feature

    def posterior(self, text: str) -> np.ndarray:
        if not self.names:
            return np.zeros(0)
        score = self.prior + self.likelihood[:, features(text)].sum(1)
        p = np.exp(score - score.max())
        return p / p.sum()


def _feature_counts(index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for text, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = counts.setdefault(index[source], np.zeros(_FEATURES + 1, np.int64))
                row[features(text)] += 1
                row[_FEATURES] += 1
        for k, row in counts.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(row[at])], ["domain", "feature", "n"])

    return run


def fit_domains(labelled: DataFrame, fit_rows: int = 20_000) -> Domains:
    """Fit on about ``fit_rows`` labelled texts, chosen by a hash of the document; domains * 2^14 counts reach the driver at most."""
    sizes = {r["source"]: r["n"] for r in labelled.groupBy("source").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Domains([], np.zeros(0), np.zeros((0, _FEATURES)))
    share = min(1.0, fit_rows / sum(sizes.values()))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    rows = sample.select("text", "source").mapInArrow(_feature_counts({n: i for i, n in enumerate(names)}), "domain bigint, feature bigint, n bigint")
    counts = np.zeros((len(names), _FEATURES + 1))
    for r in rows.groupBy("domain", "feature").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts[r.domain, r.feature] = r.n
    total = counts[:, _FEATURES]
    prior = np.log((total + 1) / (total.sum() + len(names)))
    likelihood = np.log((counts[:, :_FEATURES] + 0.05) / (total + 0.1)[:, None])
    return Domains(names, prior, likelihood)


def _measured(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def _memberships(domains: Domains, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            soft = [domains.posterior(t) for t in texts]
            best = [domains.names[int(p.argmax())] if len(p) else None for p in soft]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best, pa.string()), pa.array([len(enc.encode_ordinary(t)) for t in texts], pa.int64()), pa.array([p.tolist() for p in soft], pa.list_(pa.float64()))],
                ["doc_id", "source", "tokens", "posterior"],
            )

    return run


class Rates:
    """Nonnegative rates per document such that the expected tokens of each domain come to its target.

    The gradient is projected on [0, cap]. A document's rate depends on its posterior alone, and can be
    replayed from the residuals of the steps so far, so that no rates are stored.
    """

    def __init__(self, names: list[str], available: np.ndarray, target: np.ndarray, caps: np.ndarray):
        self.names, self.available, self.target, self.caps = names, np.maximum(available, 1e-9), target, caps
        self.steps: list[np.ndarray] = []

    def rate(self, posterior: np.ndarray) -> np.ndarray:
        """``posterior``: rows x domains."""
        cap = self.caps[posterior.argmax(1)]
        x = np.zeros(len(posterior))
        for step in self.steps:
            x = np.clip(x - posterior @ step, 0, cap)
        return x

    def step(self, reached: np.ndarray) -> float:
        residual = (reached - self.target) / self.available
        self.steps.append(residual)
        return float(np.abs(reached - self.target).sum() / max(1e-9, self.target.sum()))


def _reached(rates: Rates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(rates.names))
        for batch in batches:
            posterior = np.array(batch.column(0).to_pylist()).reshape(batch.num_rows, -1)
            total += (rates.rate(posterior) * batch.column(1).to_numpy()) @ posterior
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["domain", "tokens"])

    return run


def _with_rates(rates: Rates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posterior = np.array(batch.column(3).to_pylist()).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rates.rate(posterior))], ["doc_id", "source", "tokens", "rate"])

    return run


class Mixer:
    """Documents with their sizes and memberships, from which any number of mixes is drawn."""

    def __init__(self, spark: SparkSession, docs: DataFrame, tokenizer: str = TOKENIZER, fit_rows: int = 20_000):
        self.spark, self.scratch = spark, Scratch(spark, "mixing")
        rows = docs.where("text is not null and text <> '' and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", plain_label(F.col("source")).alias("source")).distinct()
        known = rows.where("source is not null")
        self.known = self.scratch.write(known.select("doc_id", "text", "source").mapInArrow(_measured(tokenizer), "doc_id bigint, source string, tokens bigint"), "known")
        self.domains = fit_domains(known, fit_rows)
        soft = rows.where("source is null").select("doc_id", "text").mapInArrow(_memberships(self.domains, tokenizer), "doc_id bigint, source string, tokens bigint, posterior array<double>")
        self.soft = self.scratch.write(soft.where("source is not null"), "soft")
        self.sizes = {r["source"]: r["tokens"] for r in self.known.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}

    def mix(self, shares: dict[str, float], max_repeats: dict[str, int], steps: int = 40) -> DataFrame:
        """(doc_id, source, assumed, repeats, tokens): how often each document is used; ``tokens`` once.

        Soft-membership mixing. A document with a source belongs to it; one without belongs to
        the domains by the classifier's posterior, and counts for the likeliest (``assumed``).
        The total is the largest at which every source that has documents can reach its share
        within its cap; the shares of sources without documents fall to the others in
        proportion. Whole rates are taken as they are; for the rest, documents are added in the
        order of a hash until the tokens of the source are met.

        Documents of sources in no mix, null and empty texts, and null ids aren't used; repeated rows count once;
        a mix without documents, or with no target above 0, gives no rows.
        """
        names = self.domains.names
        have = {s: w for s, w in shares.items() if w > 0 and self.sizes.get(s, 0) > 0 and max_repeats.get(s, 0) > 0}
        empty = self.spark.createDataFrame([], "doc_id bigint, source string, assumed boolean, repeats int, tokens bigint")
        if not have:
            return empty
        whole = sum(have.values())
        total = min(max_repeats[s] * self.sizes[s] / (w / whole) for s, w in have.items())
        index = {n: i for i, n in enumerate(names)}
        target, caps, hard = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for s, w in have.items():
            target[index[s]], caps[index[s]] = total * w / whole, max_repeats[s]
        for s, n in self.sizes.items():
            hard[index[s]] = n
        # Documents with a source are one group per source for the gradient: same posterior, same rate.
        ones = [([float(i == k) for i in range(len(names))], float(hard[k])) for k in range(len(names)) if hard[k]]
        groups = self.soft.select("posterior", F.col("tokens").cast("double").alias("tokens")).unionByName(self.spark.createDataFrame(ones, "posterior array<double>, tokens double"))
        groups = self.scratch.write(groups, "groups")
        soft_size = np.zeros(len(names))
        for r in self.soft.select(F.posexplode("posterior").alias("k", "p"), "tokens").groupBy("k").agg(F.sum(F.col("p") * F.col("tokens")).alias("n")).collect():
            soft_size[r["k"]] = r["n"]
        rates = Rates(names, hard + soft_size, target, caps)
        last = math.inf
        rates.step(np.zeros(len(names)))
        for _ in range(steps):
            rows = groups.mapInArrow(_reached(rates), "domain bigint, tokens double").groupBy("domain").agg(F.sum("tokens").alias("tokens")).collect()
            reached = np.zeros(len(names))
            for r in rows:
                reached[r["domain"]] = r["tokens"]
            error = np.abs(reached - target).sum() / target.sum()
            if error < 1e-4 or abs(last - error) < 1e-6:
                break
            last = error
            rates.step(reached)
        hot = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: (n == F.col("source")).cast("double"))
        known = self.known.where(F.col("source").isin(*have)).select("doc_id", "source", "tokens", hot.alias("posterior"))
        rated = known.withColumn("assumed", F.lit(False)).unionByName(self.soft.withColumn("assumed", F.lit(True)))
        flags = rated.select("doc_id", "source", "tokens", "posterior", "assumed")
        schema = "doc_id bigint, source string, tokens bigint, rate double"
        parts = [flags.where(~F.col("assumed")).select("doc_id", "source", "tokens", "posterior").mapInArrow(_with_rates(rates), schema).withColumn("assumed", F.lit(False))]
        parts.append(flags.where("assumed").select("doc_id", "source", "tokens", "posterior").mapInArrow(_with_rates(rates), schema).withColumn("assumed", F.lit(True)))
        return self._whole(self.scratch.write(parts[0].unionByName(parts[1]).where("rate > 0"), "rates"))

    def _whole(self, rated: DataFrame) -> DataFrame:
        """Whole numbers of uses: the sum over each source is met to about one document."""
        h = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(_LEVEL * _LEVEL))
        rows = rated.withColumn("base", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("h", h)
        rows = rows.withColumn("high", F.floor(F.col("h") / _LEVEL)).withColumn("low", F.col("h") % _LEVEL)
        wanted = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum((F.col("rate") - F.col("base")) * F.col("tokens")).alias("n")).collect()}
        open_ = rows.where(F.col("rate") - F.col("base") > 1e-9)
        high_cut, left = self._cut(open_.groupBy("source", "high").agg(F.sum("tokens").alias("n")), "high", wanted)
        table = self.spark.createDataFrame([(s, int(high_cut[s])) for s in high_cut], "source string, high_cut bigint")
        edge = open_.join(F.broadcast(table), "source").where("high = high_cut")
        low_cut, left = self._cut(edge.groupBy("source", "low").agg(F.sum("tokens").alias("n")), "low", left)
        cuts = self.spark.createDataFrame([(s, int(high_cut[s]), int(low_cut.get(s, 0)), float(left.get(s, 0.0))) for s in high_cut], "source string, high_cut bigint, low_cut bigint, rest double")
        # The tables of cuts have a row per source.
        marked = rows.join(F.broadcast(cuts), "source", "left")
        below = (F.col("high") < F.col("high_cut")) | ((F.col("high") == F.col("high_cut")) & (F.col("low") < F.col("low_cut")))
        at = (F.col("high") == F.col("high_cut")) & (F.col("low") == F.col("low_cut"))
        fraction = F.col("rate") - F.col("base") > 1e-9
        # The documents of one cell of 2^20: few, at any size.
        cell = marked.where(fraction & at).withColumn("run", F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_id")))
        cell = cell.where(F.col("run") - F.col("tokens") / 2 <= F.col("rest")).select("doc_id", F.lit(1).alias("last"))
        out = marked.join(cell, "doc_id", "left")
        repeats = F.col("base") + F.when(fraction & below, 1).otherwise(F.coalesce("last", F.lit(0)))
        return out.select("doc_id", "source", "assumed", repeats.cast("int").alias("repeats"), "tokens").where("repeats > 0")

    def _cut(self, cells: DataFrame, name: str, wanted: dict[str, float]) -> tuple[dict[str, int], dict[str, float]]:
        """The cell of each source in which the wanted tokens are met, and what is left for it; 1024 cells a source."""
        cut, left = {}, {}
        run: dict[str, float] = {}
        for r in cells.orderBy("source", name).collect():
            s = r["source"]
            if s not in wanted or s in cut:
                continue
            before = run.get(s, 0.0)
            if before + r["n"] > wanted[s]:
                cut[s], left[s] = r[name], wanted[s] - before
            run[s] = before + r["n"]
        for s in run:
            if s not in cut:  # all of it is wanted
                cut[s], left[s] = _LEVEL, 0.0
        return cut, left


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source of the targets (source, target_share, max_repeats): tokens drawn, share reached, documents, and most uses of one."""
    used = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("n_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"), F.sum(F.when(F.col("assumed"), F.col("tokens") * F.col("repeats"))).alias("assumed_tokens")
    )
    rows = targets.join(used, "source", "left").na.fill(0, ["n_tokens", "n_docs", "most_repeats", "assumed_tokens"])
    whole = rows.agg(F.sum("n_tokens").alias("all_tokens"))
    return rows.crossJoin(F.broadcast(whole)).select("source", "target_share", "max_repeats", "n_tokens", "n_docs", "most_repeats", "assumed_tokens", F.coalesce(F.col("n_tokens") / F.nullif("all_tokens", F.lit(0)), F.lit(0.0)).alias("reached_share"))
