"""Best representative of each duplicate group: token-level consensus, field by field."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.session import Scratch

_TOKEN = re.compile(r"[^\W\d_]+|\d+|\s+|.", re.S)
#: Cells of one table of scores; a longer alignment is cut in two, with the same result.
CELLS = 16_000_000
#: Below so many cells plain loops are quicker than arrays.
FEW_CELLS = 2_000


def tokens(value: str) -> list[str]:
    return _TOKEN.findall(value)


def _scores(columns: list[dict[str, int]], row: list[str], keep: bool) -> list:
    """Greatest numbers of matches of the first i columns with the first j tokens: all lines, or the last one."""
    n, lines = len(row), []
    if len(columns) * n <= FEW_CELLS:
        line = [0] * (n + 1)
        lines.append(line)
        for column in columns:
            above, line = line, [0]
            for j, token in enumerate(row):
                line.append(max(above[j] + column.get(token, 0), above[j + 1], line[j]))
            lines = [*lines, line] if keep else [line]
        return lines
    places: dict[str, list[int]] = {}
    for j, token in enumerate(row):
        places.setdefault(token, []).append(j)
    line = np.zeros(n + 1, np.int32)
    lines.append(line)
    for column in columns:
        gain = np.zeros(n, np.int32)
        for token, count in column.items():
            if token in places:
                gain[places[token]] = count
        # a gap costs nothing, so the best to the left is a running maximum
        line = np.maximum.accumulate(np.r_[0, np.maximum(line[1:], line[:-1] + gain)].astype(np.int32))
        if keep:
            lines.append(line)
    return lines if keep else [line]


def _align(columns: list[dict[str, int]], row: list[str]) -> list[tuple[int, int]]:
    """Pairs (column, token) from left to right, -1 for a gap on either side, with the greatest number of matches."""
    a, b = len(columns), len(row)
    if not a or not b:
        return [(i, -1) for i in range(a)] + [(-1, j) for j in range(b)]
    if a * b > CELLS and a > 1:
        half = a // 2
        before, behind = np.asarray(_scores(columns[:half], row, False)[0]), np.asarray(_scores(columns[half:][::-1], row[::-1], False)[0])
        cut = int((before + behind[::-1]).argmax())
        return _align(columns[:half], row[:cut]) + [(i + half if i >= 0 else -1, j + cut if j >= 0 else -1) for i, j in _align(columns[half:], row[cut:])]
    best = _scores(columns, row, True)
    i, j, out = a, b, []
    while i and j:
        here = best[i][j]
        if here == best[i - 1][j - 1] + columns[i - 1].get(row[j - 1], 0):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif here == best[i - 1][j]:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    out += [(k, -1) for k in range(i - 1, -1, -1)] + [(-1, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def _steps(columns: list[dict[str, int]], row: list[str]) -> list[tuple[int, int]]:
    """``_align`` after what both have in common at the ends has been put aside."""
    left, n, m = 0, len(columns), len(row)
    while left < min(n, m) and row[left] in columns[left] and len(columns[left]) == 1:
        left += 1
    right = 0
    while right < min(n, m) - left and row[m - 1 - right] in columns[n - 1 - right] and len(columns[n - 1 - right]) == 1:
        right += 1
    middle = [(i + left if i >= 0 else -1, j + left if j >= 0 else -1) for i, j in _align(columns[left : n - right], row[left : m - right])]
    return [(i, i) for i in range(left)] + middle + [(n - right + i, m - right + i) for i in range(right)]


def closest_to_consensus(values: Sequence[str], weights: Sequence[int]) -> int:
    """The place of the value that is closest to the consensus of all.

    The values are aligned one after another with the profile of those before (the number of
    values with a token counts). In each column the token (or the gap) with most weight wins, ties go to the earlier value; the distance
    of a value is the number of columns in which it differs from the consensus, ties again to
    the earlier one. Whole numbers as weights keep the sums exact.
    """
    if len(values) == 1:
        return 0
    columns: list[dict[str, int]] = []  # tokens with the number of values
    votes: list[dict[str, int]] = []  # tokens with their weight
    rows: list[dict[int, str]] = []
    for value, weight in zip(values, weights, strict=True):
        row, mine, merged = tokens(value), {}, ([], [])
        for c, t in _steps(columns, row):
            column, vote = (columns[c], votes[c]) if c >= 0 else ({}, {})
            if t >= 0:
                column[row[t]] = column.get(row[t], 0) + 1
                vote[row[t]] = vote.get(row[t], 0) + weight
                mine[id(vote)] = row[t]
            merged[0].append(column)
            merged[1].append(vote)
        columns, votes = merged
        rows.append(mine)
    total = sum(weights)
    winners: dict[int, str | None] = {}
    for vote in votes:
        token, most = None, -1
        for t, w in vote.items():  # in the order of the values
            if w > most:
                token, most = t, w
        winners[id(vote)] = token if most >= total - sum(vote.values()) else None
    distances = [sum(row.get(k) != t for k, t in winners.items()) for row in rows]
    return distances.index(min(distances))


def _winners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First columns: the values of a group in their order, and their weights or null; adds the place (from 1) of the survivor."""
    for batch in batches:
        places = []
        for values, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            # Without weights they halve along the order: a record outweighs all those after it together, as in most_trusted.
            places.append(closest_to_consensus(values, weights or [1 << i for i in reversed(range(len(values)))]) + 1)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(places, pa.int32())], [*batch.schema.names[2:], "place"])


def most_trusted(values: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(keys, value, order) of the value of each group whose record has the greatest ``order`` (a struct; nulls are least).

    Records that the order leaves equal give the greatest of their values. Null values are no candidates (a group of
    nulls gives no row), nulls in ``keys`` form groups of their own, other columns aren't read, an empty table gives an
    empty result. This is what votes that halve along the order come to, so nothing is aligned or counted.
    """
    known = values.where(F.col(value).isNotNull())
    best = known.groupBy(*keys).agg(F.max(F.struct(F.struct(*[F.col(c) for c in order]).alias("o"), F.col(value).alias("v"))).alias("_best"))
    return best.select(*keys, F.col("_best.v").alias(value), *[F.col("_best.o")[c].alias(c) for c in order])


def consensus_survivors(spark: SparkSession, values: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], chunk: int = 64, weight: str | None = None) -> DataFrame:
    """(keys, value, order) of the surviving value of each group.

    ``values`` has the columns ``keys`` of a group, a STRING ``value`` and the columns ``order``; the
    record with the greatest ``order`` (a struct; nulls are least) is trusted most. Equal values of
    a group count as one, with their most trusted record.

    ``weight`` names a column of whole numbers; equal values add theirs up (null or less than 1 counts as 1), and the votes decide. Without
    it the order alone decides, without a vote: ``most_trusted``.

    Groups of more than ``chunk`` different values are split by a hash, and the survivors of the
    parts meet again, with the weight of their whole part, in as many levels as it takes, so no task ever holds a large group. The
    result is that of this tournament. Null values are no
    candidates (a group of nulls gives no row), nulls in ``keys`` form groups of their own,
    other columns aren't read, an empty table gives an empty result.
    """
    if weight is None:
        return most_trusted(values, keys, value, order)
    scratch = Scratch(spark, "consensus")
    order_struct = F.struct(*[F.col(c) for c in order]).alias("_o")
    votes = F.greatest(F.coalesce(F.col(weight).cast("bigint"), F.lit(1)), F.lit(1))
    now = values.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), order_struct, votes.alias("_w"))
    now = scratch.write(now.groupBy(*keys, "_v").agg(F.max("_o").alias("_o"), F.sum("_w").alias("_w")), "candidates")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    while True:
        sizes = now.groupBy(*keys).agg(F.count("*").alias("_n"))
        largest = sizes.agg(F.max("_n")).first()[0] or 0
        final = largest <= chunk
        if final:
            grouped = now.withColumn("_part", F.lit(0))
        else:
            on = same[0]
            for s in same[1:]:
                on = on & s
            part = F.pmod(F.xxhash64("l._v"), F.ceil(F.col("r._n") / chunk)).cast("int")
            grouped = now.alias("l").join(sizes.alias("r"), on).select("l.*", part.alias("_part"))
        lists = grouped.groupBy(*keys, "_part").agg(F.sort_array(F.collect_list(F.struct("_o", "_v", "_w")), asc=False).alias("_all"), F.sum("_w").alias("_w"))
        alone = lists.where("size(_all) = 1").select(*keys, F.col("_all")[0]["_v"].alias("_v"), F.col("_all")[0]["_o"].alias("_o"), "_w")
        contested = lists.where("size(_all) > 1").select(F.col("_all._v").alias("_values"), F.col("_all._w").alias("_weights"), *keys, "_all", "_w")
        fields = [f for f in contested.schema.fields if f.name not in ("_values", "_weights")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", place int"
        voted = contested.mapInArrow(_winners, schema)
        voted = voted.select(*keys, F.element_at("_all", F.col("place"))["_v"].alias("_v"), F.element_at("_all", F.col("place"))["_o"].alias("_o"), "_w")
        result = alone.unionByName(voted)
        if final:
            return result.select(*keys, F.col("_v").alias(value), *[F.col("_o")[c].alias(c) for c in order])
        after = scratch.write(result, "level")
        scratch.drop(now)
        now = after
