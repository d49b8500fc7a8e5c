"""Same or near-same records across splits: a prefix-filter join on shingles of 64-bit hashes."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.normalize import EVAL_SPLITS, hash_bits, path_part, plain_digest, plain_name, plain_split
from spanforge.session import Scratch

_VALUE_BITS, _RANK_SHIFT = 36, 44


@dataclass(frozen=True)
class Shingling:
    """A hash as a set of shingles: every choice of ``width`` of its ``blocks`` runs of bits, with their values.

    Two hashes that differ in ``distance`` bits differ in as many blocks at most, so they share
    ``least_shared`` of their ``size`` shingles at least. Hence the rarest ``prefix`` shingles
    of either hash, in one order for both, have one in common: nothing is lost.
    """

    blocks: int
    width: int
    distance: int

    @property
    def bounds(self) -> list[tuple[int, int]]:
        """Shift and number of bits of each block, low bits first."""
        short, longer = divmod(64, self.blocks)
        out, at = [], 0
        for i in range(self.blocks):
            bits = short + (i < longer)
            out.append((at, bits))
            at += bits
        return out

    @property
    def combinations(self) -> list[tuple[int, ...]]:
        return list(itertools.combinations(range(self.blocks), self.width))

    @property
    def size(self) -> int:
        return math.comb(self.blocks, self.width)

    @property
    def least_shared(self) -> int:
        return math.comb(self.blocks - self.distance, self.width)

    @property
    def prefix(self) -> int:
        return self.size - self.least_shared + 1

    def block(self, c: Column, i: int) -> Column:
        shift, bits = self.bounds[i]
        return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << bits) - 1))

    def shingle(self, c: Column, number: int) -> Column:
        """The number of the choice of blocks in the high bits, the values of its blocks below."""
        out = F.lit(0).cast("bigint")
        for i in self.combinations[number]:
            out = F.shiftleft(out, self.bounds[i][1]).bitwiseOR(self.block(c, i))
        return out.bitwiseOR(F.lit(number << _VALUE_BITS))


def ladder(distance: int) -> list[Shingling]:
    """From few, common shingles to many, rare ones.

    With ``distance + width`` blocks one shared shingle is certain, so the prefix is the whole set. A block
    more would let the prefix leave out a few, but of more and shorter shingles: 19 of 21 with 18 bits
    instead of 15 with 21, 53 of 56 with 24 bits instead of 35 with 27.
    """
    return [Shingling(distance + width, width, distance) for width in (2, 3, 4)]


def _block_counts(hashes: DataFrame, shingling: Shingling) -> dict[tuple[int, int], int]:
    """How many hashes have each value of each block: blocks * 2^(64 / blocks) numbers at most, whatever the size."""
    blocks = F.array(*[F.struct(F.lit(i).alias("i"), shingling.block(F.col("h"), i).alias("value")) for i in range(shingling.blocks)])
    rows = hashes.select(F.explode(blocks).alias("b")).groupBy("b.i", "b.value").count().collect()
    return {(r["i"], r["value"]): r["count"] for r in rows}


def _expected(left: dict, right: dict, n_left: int, n_right: int, shingling: Shingling) -> float:
    """Pairs that share a shingle, from the counts of the blocks as if those were independent."""
    same = [sum(left.get(k, 0) / n_left * n / n_right for k, n in right.items() if k[0] == i) for i in range(shingling.blocks)]
    return n_left * n_right * sum(math.prod(same[i] for i in c) for c in shingling.combinations)


class PrefixIndex:
    """The order of the shingles, and the rows of an index or of a probe."""

    def __init__(self, shingling: Shingling, counts: dict[tuple[int, int], int]):
        self.shingling = shingling
        self.ranks = []
        # a prefix that leaves nothing out needs no order
        for i, (_, bits) in enumerate(shingling.bounds if shingling.prefix < shingling.size else []):
            # 16 steps for each doubling of a value's count; one literal a table, not one a value
            steps = (str(round(16 * math.log2(1 + counts.get((i, v), 0)))) for v in range(1 << bits))
            self.ranks.append(F.split(F.lit(",".join(steps)), ",").cast("array<int>"))

    def rows(self, hashes: DataFrame) -> DataFrame:
        """(shingle, h) for the rarest shingles of each hash ``h``."""
        s = self.shingling
        if s.prefix == s.size:
            return hashes.select(F.explode(F.array(*[s.shingle(F.col("h"), number) for number in range(s.size)])).alias("shingle"), "h")
        ranked = [self._ranked(blocks, number) for number, blocks in enumerate(s.combinations)]
        order = F.slice(F.sort_array(F.array(*ranked)), 1, s.prefix)
        return hashes.select("h", F.explode(order).alias("x")).select(F.col("x").bitwiseAND(F.lit((1 << _RANK_SHIFT) - 1)).alias("shingle"), "h")

    def _ranked(self, blocks: tuple[int, ...], number: int) -> Column:
        s, h = self.shingling, F.col("h")
        rank = F.lit(0)
        for i in blocks:
            rank = rank + F.get(self.ranks[i], s.block(h, i).cast("int"))
        return F.shiftleft(rank.cast("bigint"), _RANK_SHIFT).bitwiseOR(s.shingle(h, number))


def choose(probe: DataFrame, index: DataFrame, distance: int, per_row: float = 30.0) -> PrefixIndex:
    """The shingling with the fewest shingles whose expected pairs are at most ``per_row`` for each row."""
    picked = None
    for shingling in ladder(distance):
        left, right = _block_counts(probe, shingling), _block_counts(index, shingling)
        n_left = sum(n for (i, _), n in left.items() if i == 0) or 1
        n_right = sum(n for (i, _), n in right.items() if i == 0) or 1
        counts = {k: left.get(k, 0) + right.get(k, 0) for k in {*left, *right}}
        picked = PrefixIndex(shingling, counts)
        if _expected(left, right, n_left, n_right, shingling) <= per_row * (n_left + n_right):
            break
    return picked


def near_probe(spark: SparkSession, probe: DataFrame, index: DataFrame, distance: int = 4) -> DataFrame:
    """The distinct hashes ``h`` of ``probe`` with one of ``index`` at ``distance`` bits at most.

    Both have a BIGINT column ``h``; nulls match nothing; repeated hashes count once. The
    rarest shingles of the probe are joined with those of the index, always by a sort-merge
    join: the planner takes their rows for as large as the hashes before they are multiplied,
    and would send them all through the driver as a broadcast. Lengths filter first
    (numbers of one-bits that differ by more than ``distance`` can't match), and as all
    hashes have as many shingles, the cut of the prefix already is the position filter. The
    distance of every pair that is left is then verified.
    """
    scratch = Scratch(spark, "hashes")
    probe = scratch.write(probe.where("h is not null").select("h").distinct(), "probe")
    index = scratch.write(index.where("h is not null").select("h").distinct(), "index")
    prefixes = choose(probe, index, distance)
    p, t = prefixes.rows(probe).alias("p"), prefixes.rows(index).alias("t").hint("merge")
    length = F.abs(F.bit_count(F.col("p.h")) - F.bit_count(F.col("t.h"))) <= distance
    verified = F.bit_count(F.col("p.h").bitwiseXOR(F.col("t.h"))) <= distance
    return p.join(t, (F.col("p.shingle") == F.col("t.shingle")) & length & verified, "left_semi").select("h").distinct()


def cross_split(spark: SparkSession, images: DataFrame, distance: int = 4, with_dataset: bool = True) -> DataFrame:
    """One row (manifest_index, split, match_kind, and dataset if wanted) for each evaluation record.

    ``match_kind`` is 'exact' when a training record has its digest, else 'near' when a training
    record's perceptual hash is at ``distance`` bits at most, else null. A record without a known
    split takes the one in its path and is left out if that says none either. Missing digests
    and hashes match nothing; a repeated row may come out repeated; other columns aren't read; an
    empty table gives an empty result.
    """
    scratch = Scratch(spark, "overlap")
    split = F.coalesce(plain_split(F.col("split")), plain_split(path_part(F.col("image"), 1)))
    dataset = [plain_name(path_part(F.col("image"), 2)).alias("dataset")] if with_dataset else []
    rows = images.select(F.col("manifest_index").cast("bigint").alias("manifest_index"), split.alias("split"), F.unhex(plain_digest(F.col("sha256"))).alias("d"), hash_bits(F.col("phash")).alias("h"), *dataset)
    rows = scratch.write(rows.where("split is not null"), "plain")
    held, train = rows.where(F.col("split").isin(*EVAL_SPLITS)), rows.where("split = 'train'")
    seen = train.where("d is not null").select("d", F.lit(True).alias("same")).distinct()
    # Missing digests and hashes would all meet in one task of a left join.
    known = held.where("d is not null").join(seen, "d", "left").drop("d")
    held = scratch.write(known.unionByName(held.where("d is null").drop("d").withColumn("same", F.lit(None).cast("boolean"))), "exact")
    near = near_probe(spark, held.where("same is null").select("h"), train.select("h"), distance).withColumn("close", F.lit(True))
    kind = F.when(F.col("same"), "exact").when(F.col("close"), "near")
    open_ = F.col("h").isNotNull() & F.col("same").isNull()
    hashed = held.where(open_).join(near, "h", "left").withColumn("match_kind", kind)
    rest = held.where(~open_).withColumn("match_kind", F.when(F.col("same"), "exact"))
    return hashed.drop("h", "same", "close").unionByName(rest.drop("h", "same"))
