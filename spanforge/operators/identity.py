"""Content-addressed identity: canonical digests, tags, reuse of stages, frozen names, configuration."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

TAG_DIGITS = 12


def canonical_digest(value: Any, spaced: bool = False) -> str:
    """SHA-256 of JSON with sorted keys; ``spaced`` keeps the blanks that older tags had after commas and colons."""
    separators = (", ", ": ") if spaced else (",", ":")
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=separators, ensure_ascii=spaced, default=str).encode()).hexdigest()


@pandas_udf(StringType())
def canonical_json_digest(texts: pd.Series) -> pd.Series:
    """The canonical digest of JSON texts; null for null and for text that isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical_digest(json.loads(text))
        except ValueError:
            return None

    return texts.map(one)


def tag(prefix: str, digest: str) -> str:
    if not re.fullmatch(r"[0-9a-f]{64}", digest):
        raise ValueError(f"not a digest: {digest!r}")
    return prefix + digest[:TAG_DIGITS]


def tags_in(text: Column, prefix: str) -> Column:
    """All different tags in a text, sorted; a longer run of hex digits is none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rf"({re.escape(prefix)}[0-9a-f]{{{TAG_DIGITS}}})(?![0-9a-f])"), F.lit(1))))


def merged(base: Mapping, over: Mapping) -> dict:
    """Maps merged at every depth; other values are replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def inherited(name: str, documents: Mapping[str, Mapping], parent: str = "inherits", _seen: tuple[str, ...] = ()) -> dict:
    """A configuration over those that it inherits from; a cycle is an error."""
    if name in _seen:
        raise ValueError("cycle: " + " -> ".join((*_seen, name)))
    doc = dict(documents[name])
    base = doc.pop(parent, None)
    return merged(inherited(base, documents, parent, (*_seen, name)), doc) if base else doc


def dotted(config: Mapping, path: str, default: Any = None) -> Any:
    at: Any = config
    for part in path.split("."):
        if not isinstance(at, Mapping) or part not in at:
            return default
        at = at[part]
    return at


def config_digest(config: Mapping, without: tuple[str, ...] = ("runtime",)) -> str:
    return canonical_digest({k: v for k, v in config.items() if k not in without})


def reusable(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per stage of ``wanted`` (stage, config_hash, input_hash, output_hash): may its last state be used again, and if not, why.

    ``state`` has the same columns with status and updated_at; the latest row of a stage counts.
    """
    last = state.groupBy("stage").agg(F.max_by(F.struct("status", "config_hash", "input_hash", "output_hash"), "updated_at").alias("s"))
    reason = (
        F.when(F.col("s").isNull(), "no_state").when(F.col("s.status") != "complete", "not_complete").when(F.col("s.config_hash") != F.col("config_hash"), "config_changed")
        .when(F.col("s.input_hash") != F.col("input_hash"), "input_changed").when(~F.col("s.output_hash").eqNullSafe(F.col("output_hash")), "output_changed")
    )
    return wanted.join(last, "stage", "left").select("stage", reason.isNull().alias("reusable"), reason.alias("reason"))


def resume(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per run: FRESH, RESUME, ALREADY or STALE, from its hash and how far it had come (epoch, epochs)."""
    joined = wanted.select("run", F.col("train_hash").alias("_want")).join(state, "run", "left")
    kind = F.when(F.col("train_hash").isNull(), "FRESH").when(F.col("train_hash") != F.col("_want"), "STALE").when(F.col("epoch") >= F.col("epochs"), "ALREADY").otherwise("RESUME")
    return joined.select("run", kind.alias("decision"))


def verified(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): ok, CHANGED, MISSING or extra, of two lists (path, sha256)."""
    both = expected.select("path", F.col("sha256").alias("e")).join(found.select("path", F.col("sha256").alias("f")), "path", "full")
    status = F.when(F.col("f").isNull(), "MISSING").when(F.col("e").isNull(), "extra").when(F.col("e") != F.col("f"), "CHANGED").otherwise("ok")
    return both.select("path", status.alias("status"))


def freeze(registry: DataFrame, name: str, digest: str) -> DataFrame:
    """The registry (name, digest) with a new entry; the same again changes nothing, other content under a name is an error."""
    old = [r["digest"] for r in registry.where(F.col("name") == name).select("digest").limit(2).collect()]
    if old and old[0] != digest:
        raise ValueError(f"{name} is frozen with other content")
    return registry if old else registry.unionByName(registry.sparkSession.createDataFrame([(name, digest)], "name string, digest string"))
