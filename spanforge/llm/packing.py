"""Filling fixed-capacity containers: best fit with conflicts, over bins ordered by residual."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.normalize import plain_label, words_only
from spanforge.llm.tokens import TOKENIZER, cut, encoding
from spanforge.session import Scratch

PIECES = "pack_name string, doc_id bigint, source string, cluster bigint, piece int, n_pieces int, char_start bigint, char_end bigint, tokens int"


def best_fit(sizes: Sequence[int], capacity: int, clusters: Sequence[int], sources: Sequence[int], apart: dict[int, int]) -> list[int]:
    """The bin of each item, largest items first; copies count as larger, the more bins they need to lie apart.

    Bins of equal residual are kept together, and a bit for each residual with a bin gives the
    successor of a size. An item may not join a bin that holds its cluster, or a source that
    ``apart`` (source to a bitmap of sources) forbids beside its own; the search then goes on
    to the next bin, and to the next residual, until the tightest compatible bin is found.
    Ties: the bin that was last changed. An item larger than the capacity gets a bin alone.
    """
    repeats: dict[int, int] = defaultdict(int)
    for c in clusters:
        repeats[c] += 1
    # Copies that come last would each open a bin, though there was room for them before.
    bins_needed = max(1.0, sum(sizes) / capacity)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i] - capacity * (repeats[clusters[i]] - 1) / bins_needed, -sizes[i], i))
    bit = {c: k for k, c in enumerate(c for c, n in repeats.items() if n > 1)}
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    inside: list[dict[int, int]] = [defaultdict(int) for _ in range(capacity + 1)]  # residual: cluster bit -> bins that hold it
    held: list[list[int]] = []  # cluster bits of a bin
    cluster_map: list[int] = []
    source_map: list[int] = []
    present, out = 0, [0] * len(sizes)
    for item in order:
        size, mine, source = sizes[item], bit.get(clusters[item], -1), sources[item]
        forbidden = apart.get(source, 0)
        chosen = residual = place = -1
        mask = present >> size if size <= capacity else 0
        while mask:
            step = (mask & -mask).bit_length() - 1
            residual = size + step
            bins = at[residual]
            if mine < 0 and not forbidden:
                place = len(bins) - 1
                chosen = bins[place]
                break
            if mine < 0 or inside[residual].get(mine, 0) < len(bins):
                for place in range(len(bins) - 1, -1, -1):
                    b = bins[place]
                    if (mine < 0 or not cluster_map[b] >> mine & 1) and not source_map[b] & forbidden:
                        chosen = b
                        break
            if chosen >= 0:
                break
            mask &= mask - 1
        if chosen < 0:
            chosen, left = len(held), max(0, capacity - size)
            held.append([])
            cluster_map.append(0)
            source_map.append(0)
        else:
            bins = at[residual]
            bins[place] = bins[-1]
            bins.pop()
            for k in held[chosen]:
                inside[residual][k] -= 1
            if not bins:
                present &= ~(1 << residual)
            left = residual - size
        if mine >= 0:
            held[chosen].append(mine)
            cluster_map[chosen] |= 1 << mine
        source_map[chosen] |= 1 << source
        at[left].append(chosen)
        for k in held[chosen]:
            inside[left][k] += 1
        present |= 1 << left
        out[item] = chosen
    return out


def _pieces(capacities: Mapping[str, int], tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for batch in batches:
            ids, texts, sources, prints = (batch.column(i).to_pylist() for i in range(4))
            rows: list[tuple] = []
            for doc, text, source, mark in zip(ids, texts, sources, prints, strict=True):
                size = len(enc.encode_ordinary(text))
                for name, capacity in capacities.items():
                    parts = ([(0, len(text), size)] if size else []) if size <= capacity else cut(text, capacity, tokenizer)
                    # Pieces of one text aren't copies of each other.
                    rows += [(name, doc, source, (mark + 0x9E3779B97F4A7C15 * k + 2**63) % 2**64 - 2**63, k + 1, len(parts), *part) for k, part in enumerate(parts)]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _packer(capacities: Mapping[str, int], apart: Iterable[tuple[str, str]], label: str):
    pairs = list(apart)

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        names = {n: i for i, n in enumerate(sorted({*items["source"].dropna(), *(x for p in pairs for x in p)}), 1)}
        forbid: dict[int, int] = defaultdict(int)
        for a, b in pairs:
            forbid[names[a]] |= 1 << names[b]
            forbid[names[b]] |= 1 << names[a]
        sources = [names.get(s, 0) if s is not None else 0 for s in items["source"]]
        capacity = capacities[key[0]]
        bins = best_fit(items["tokens"].tolist(), capacity, items["cluster"].tolist(), sources, forbid)
        items["pack_id"] = [f"{label}-{key[1]}-{b}" for b in bins]
        fill = items.groupby("pack_id")["tokens"].transform("sum")
        items["fill"] = (fill / capacity).astype(float)
        return items.drop(columns="part")

    return run


def pieces(docs: DataFrame, capacities: Mapping[str, int], tokenizer: str = TOKENIZER) -> DataFrame:
    """The items to pack for each capacity: each text whole, or cut if it alone exceeds the capacity. Every text is tokenised once, and again only where it is cut."""
    text = F.col("text")
    mark = F.xxhash64(F.coalesce(F.nullif(words_only(text), F.lit("")), text))
    rows = docs.where("text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", plain_label(F.col("source")).alias("source"), mark.alias("mark"))
    return rows.mapInArrow(_pieces(capacities, tokenizer), PIECES)


def pack_all(
    spark: SparkSession, docs: DataFrame, capacities: Mapping[str, int], tokenizer: str = TOKENIZER, apart: Iterable[tuple[str, str]] = (), per_task: int = 20_000, full: float = 0.97
) -> DataFrame:
    """Texts of ``docs`` (doc_id, text, source) in packs of each of ``capacities`` (tokens by name): one row per size and piece.

    Conflict-constrained best fit. Copies (texts with the same words) may not share a pack, nor
    may the pairs of sources in ``apart``. Only a text larger than the capacity is divided,
    into pieces that fill packs but for the last. Items are dealt to tasks of about
    ``per_task`` by a hash, so that no source or set of copies meets in one task; packs that
    end below the share ``full`` are opened again and their items dealt anew, over fewer tasks,
    until one task has them all or they don't get fewer. No pack is lost or left over.

    Null and empty texts have no tokens and give no row; repeated rows are packed once; a null
    doc_id is packed like others; a null source conflicts with nothing; other columns aren't
    read; an empty table gives an empty result.
    """
    scratch = Scratch(spark, "packing")
    rest = scratch.write(pieces(docs, capacities, tokenizer).distinct(), "pieces")
    schema = PIECES + ", pack_id string, fill double"
    name = F.col("pack_name")
    done, level, before = None, 0, dict.fromkeys(capacities, math.inf)
    while True:
        items = {r["pack_name"]: r["count"] for r in rest.groupBy("pack_name").count().collect()}  # a row per size
        tasks = {k: max(1, math.ceil(n / per_task)) for k, n in items.items()}
        last = [k for k, n in items.items() if tasks[k] == 1 or n > 0.9 * before[k]]
        parts = F.coalesce(*[F.when(name == k, F.lit(n)) for k, n in tasks.items()], F.lit(1))
        part = F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), parts).cast("int")
        packed = rest.withColumn("part", part).groupBy("pack_name", "part").applyInPandas(_packer(capacities, apart, str(level)), schema)
        packed = scratch.write(packed, "packs")
        closed = packed.where(name.isin(last) | (F.col("fill") >= full))
        done = closed if done is None else done.unionByName(closed)
        if len(last) == len(items):
            return done
        before |= items
        rest, level = packed.where(~name.isin(last) & (F.col("fill") < full)).drop("pack_id", "fill"), level + 1


def pack(spark: SparkSession, docs: DataFrame, capacity: int, tokenizer: str = TOKENIZER, apart: Iterable[tuple[str, str]] = (), per_task: int = 20_000, full: float = 0.97) -> DataFrame:
    """``pack_all`` for one capacity."""
    return pack_all(spark, docs, {"": capacity}, tokenizer, apart, per_task, full).drop("pack_name")


def pack_checks(packed: DataFrame, capacities: Mapping[str, int], apart: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Per size: documents packed, and how often a rule is broken (packs over the capacity, texts divided that would fit, pieces lost,
    copies or sources that may not meet in one pack, more packs than 1.01 times the tokens take, and one)."""
    name = F.col("pack_name")
    capacity = F.coalesce(*[F.when(name == k, F.lit(n)) for k, n in capacities.items()])
    held = lambda s: F.bool_or(F.coalesce(F.col("source") == s, F.lit(False)))
    meet = sum((F.when(held(a) & held(b), 1).otherwise(0) for a, b in apart), F.lit(0))
    packs = packed.groupBy("pack_name", "pack_id").agg(F.sum("tokens").alias("t"), (F.count("*") - F.countDistinct("cluster")).alias("copies"), meet.alias("meet"))
    a = packs.groupBy("pack_name").agg(F.count_if(F.col("t") > capacity).alias("n_overfull"), F.sum("copies").alias("n_copies_together"), F.sum("meet").cast("bigint").alias("n_sources_together"), F.count("*").alias("n"), F.sum("t").alias("t"))
    texts = packed.groupBy("pack_name", "doc_id").agg(F.count("*").alias("k"), F.max("n_pieces").alias("n"), F.sum("tokens").alias("t"))
    b = texts.groupBy("pack_name").agg(F.count("*").alias("n_docs"), F.count_if((F.col("n") > 1) & (F.col("t") <= capacity)).alias("n_small_divided"), F.count_if(F.col("k") % F.col("n") != 0).alias("n_pieces_lost"))
    over = (F.col("n") > 1.01 * F.ceil(F.col("t") / capacity) + 1).cast("int").alias("n_too_many_packs")
    return a.join(b, "pack_name").select("pack_name", "n_docs", "n_overfull", "n_small_divided", "n_pieces_lost", "n_copies_together", "n_sources_together", over)


def pack_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Number of packs, tokens, and the share of the room that is used."""
    per_pack = packed.groupBy("pack_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    return per_pack.agg(
        F.count("*").alias("n_packs"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.max("tokens").alias("largest"),
        (F.sum("tokens") / (F.count("*") * F.lit(capacity))).alias("filled"),
    )
