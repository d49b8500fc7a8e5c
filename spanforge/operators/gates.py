"""Gates: a frame of violations that has to be empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(AssertionError):
    pass


def assert_empty(violations: DataFrame, message: str, shown: int = 10) -> None:
    """Raise with a few of the violations, of which ``shown`` rows reach the driver."""
    rows = violations.limit(shown).collect()
    if rows:
        raise GateError(f"{message}: {[r.asDict() for r in rows]}")


def problems(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row (key, problem) for each rule that a row breaks; a rule that is null isn't broken."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(*key, F.explode(names).alias("problem"))


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the name of the side; repeated rows count as often as they come."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def count_conflicts(df: DataFrame, expected: dict[str, tuple[Column, int]]) -> DataFrame:
    """All counts (as conditions) that aren't as expected."""
    counts = df.agg(*[F.count_if(c).alias(n) for n, (c, _) in expected.items()])
    rows = [counts.select(F.lit(n).alias("what"), F.col(f"`{n}`").alias("found"), F.lit(k).cast("bigint").alias("expected")) for n, (_, k) in expected.items()]
    return reduce(DataFrame.unionByName, rows).where("found <> expected")
