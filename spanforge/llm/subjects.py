"""Subject areas of documents: class-association rules over the words of paragraphs."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.session import Scratch

_WORD = re.compile(r"[a-z0-9]+")
_ASIDE = re.compile(r"\([^()]*\)")
_TAG = re.compile(r"<[^<>]{0,40}>")
_BREAK = re.compile(r"\n[ \t]*\n")
_STOP = re.compile(r"[.;:,|!?]")
# Letters without a decomposition, and signs that don't show.
_LETTERS = str.maketrans({"đ": "d", "ß": "ss", "ł": "l", "ø": "o", "\u200b": None, "\xad": None, "\xa0": " "})
# Scanning takes these for each other.
_SCANNED = str.maketrans("01c", "ole")
# Accents, once they are characters by themselves.
_PLAIN = {i: None for i in range(0x300, 0x10000) if unicodedata.combining(chr(i))} | _LETTERS


def repaired(text: str) -> str:
    """UTF-8 that was read as a single-byte encoding is read again."""
    if any(x in text for x in ("Ã", "á»", "Ä", "Æ°")):
        for wrong in ("latin-1", "cp1252"):
            try:
                return text.encode(wrong).decode("utf-8")
            except ValueError:
                continue
    return text


def paragraphs(text: str) -> list[str]:
    """The paragraphs in lower case, without markup and accents."""
    text = _TAG.sub("\n", html.unescape(repaired(text))).replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.lower()).translate(_PLAIN)
    return [p.strip() for p in _BREAK.split(text.lower()) if p.strip()]


class _Codes(dict):
    """Words to 64-bit codes, in a form that swapped letters and scanning errors leave as it is: 0 for numbers; the lowest bit is set for words of three letters and more."""

    def __missing__(self, word: str) -> int:
        code = 0
        if not word.isdigit():
            form = word.translate(_SCANNED)
            form = "".join(sorted(form)) if len(form) >= 5 else form
            code = (xxhash.xxh64_intdigest(form) & ~1 | (len(form) >= 3) or 2) - 2**63
        if len(self) < 500_000:  # only a memo
            self[word] = code
        return code


def paragraph_items(parts: list[str], codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Items of all paragraphs, each once and in order, and the offsets of the paragraphs.

    Items are words of three letters and more, and pairs of neighbouring words in a clause. What stands in brackets is an aside and left out, as are numbers.
    """
    words, lengths, rows = [], [], []
    for k, part in enumerate(parts):
        for clause in _STOP.split(_ASIDE.sub(" . ", part)):
            found = _WORD.findall(clause)
            if found:
                words += map(codes.__getitem__, found)
                lengths.append(len(found))
                rows.append(k)
    code = np.array(words, np.int64)
    clause = np.repeat(np.arange(len(lengths)), lengths)
    row = np.repeat(np.array(rows, np.int64), lengths)
    keep = code != 0
    code, clause, row = code[keep], clause[keep], row[keep]
    wide = code.view(np.uint64)
    with np.errstate(over="ignore"):
        pair = wide[:-1] * np.uint64(0x9E3779B97F4A7C15) + (wide[1:] ^ (wide[1:] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        pair ^= pair >> np.uint64(31)
    near = clause[1:] == clause[:-1]
    single = (code & 1) == 1
    items, at = np.r_[code[single], pair.view(np.int64)[near]], np.r_[row[single], row[1:][near]]
    order = np.lexsort((items, at))
    items, at = items[order], at[order]
    first = np.r_[True, (items[1:] != items[:-1]) | (at[1:] != at[:-1])][: len(items)]
    items, at = items[first], at[first]
    return items, np.r_[0, np.cumsum(np.bincount(at, minlength=len(parts)))].astype(np.int32)


_ROW = "doc_id bigint, para int, size int, items array<bigint>"
_NAMES = ["doc_id", "para", "size", "items"]


def _transactions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paragraphs of texts (doc_id, text) as rows."""
    codes = _Codes()
    for batch in batches:
        ids, numbers, parts = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mine = paragraphs(text)
            parts += mine
            ids += [doc] * len(mine)
            numbers += range(len(mine))
        items, offsets = paragraph_items(parts, codes)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(items))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array([len(p) for p in parts], pa.int32()), lists], _NAMES)


def _labelled_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document (doc_id, text, classes), with the lists of its paragraphs' items."""
    codes = _Codes()
    for batch in batches:
        parts, counts = [], [0]
        for text in batch.column(1).to_pylist():
            parts += paragraphs(text)
            counts.append(len(parts))
        items, offsets = paragraph_items(parts, codes)
        inner = pa.ListArray.from_arrays(pa.array(offsets), pa.array(items))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), inner)], ["doc_id", "classes", "parts"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Items of all rows, and the row of each."""
    counts = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), counts)


def _encoded(lists: pa.Array, codes: np.ndarray, places: np.ndarray) -> pa.Array:
    """Lists with items replaced by their place in the list of frequent ones, in that order, without the others."""
    items, row = _flat(lists)
    at = np.searchsorted(codes, items)
    at[at == len(codes)] = 0
    keep = codes[at] == items if len(codes) else np.zeros(len(items), bool)
    ids, row = places[at[keep]], row[keep]
    order = np.lexsort((ids, row))
    offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(lists)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[order].astype(np.int32)))


def _encoder(codes: np.ndarray, places: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _encoded(batch.column(3), codes, places)], _NAMES)

    return run


def _document_encoder(codes: np.ndarray, places: np.ndarray):
    """The same for labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2)
            counts = pa.array(np.r_[0, np.cumsum(np.diff(parts.offsets.to_numpy()))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(counts, _encoded(parts.flatten(), codes, places))], ["doc_id", "classes", "parts"])

    return run


def _extended(pattern: np.ndarray, at: np.ndarray, last: np.ndarray, ids: np.ndarray, row: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pattern found in a row with each later item of that row: code, row and the new item. ``ids`` are sorted within sorted rows."""
    key = row * n_items + ids
    start, end = np.searchsorted(key, at * n_items + last, "right"), np.searchsorted(key, (at + 1) * n_items)
    counts = end - start
    which = np.repeat(np.arange(len(pattern)), counts)
    place = np.arange(len(which)) + np.repeat(start - (np.cumsum(counts) - counts), counts)
    return pattern[which] * n_items + ids[place], at[which], ids[place]


@dataclass
class Level:
    """Patterns of one length by code (the number of the shorter pattern * items + the last item), sorted."""

    codes: np.ndarray
    kind: np.ndarray  # class of the rule; -1: none
    weight: np.ndarray
    open: np.ndarray  # longer patterns grow from it


@dataclass
class Rules:
    """Rules antecedent -> class: single items by place, longer patterns by level."""

    classes: int
    n_items: int
    item_class: np.ndarray  # -1: no rule
    item_weight: np.ndarray
    grown: np.ndarray  # items that patterns are grown from
    levels: list[Level] = field(default_factory=list)

    def found(self, ids: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per level the rows, classes and weights of matching rules; then the extensions of the open patterns of the last level: codes and rows."""
        m = self.item_class[ids] >= 0
        yield row[m], self.item_class[ids[m]], self.item_weight[ids[m]], None
        g = self.grown[ids]
        mine, where = ids[g].astype(np.int64), row[g].astype(np.int64)
        pattern, at, last = mine, where, mine
        for level in self.levels:
            codes, at, last = _extended(pattern, at, last, mine, where, self.n_items)
            pattern = np.searchsorted(level.codes, codes)
            pattern[pattern == len(level.codes)] = 0
            m = level.codes[pattern] == codes if len(level.codes) else np.zeros(len(codes), bool)
            pattern, at, last = pattern[m], at[m], last[m]
            r = level.kind[pattern] >= 0
            yield at[r], level.kind[pattern[r]], level.weight[pattern[r]], None
            o = level.open[pattern]
            pattern, at, last = pattern[o], at[o], last[o]
        codes, at, _ = _extended(pattern, at, last, mine, where, self.n_items)
        yield at, codes, codes, codes

    def evidence(self, ids: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights and number of matching rules per row and class."""
        total, hits = np.zeros(rows * self.classes), np.zeros(rows * self.classes)
        for at, kind, weight, extensions in self.found(ids, row):
            if extensions is None:
                cell = at * self.classes + kind
                total += np.bincount(cell, weight, len(total))
                hits += np.bincount(cell, minlength=len(total))
        return total.reshape(rows, -1), hits.reshape(rows, -1)

    def listed(self) -> set[tuple[int, ...]]:
        """Rules as (items..., class)."""
        out = {(int(i), int(self.item_class[i])) for i in np.flatnonzero(self.item_class >= 0)}
        names: list[tuple[int, ...]] = [(i,) for i in range(self.n_items)]
        for level in self.levels:
            names = [(*names[c // self.n_items], int(c % self.n_items)) for c in level.codes]
            out |= {(*names[i], int(level.kind[i])) for i in np.flatnonzero(level.kind >= 0)}
        return out

    def changed(self, other: Rules) -> float:
        """Share of the rules of both that only one has."""
        mine, others = self.listed(), other.listed()
        return len(mine ^ others) / max(1, len(mine | others))


def _best(total: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best class, its evidence, its share of all evidence, and its number of rules."""
    rows = np.arange(len(total))
    k = total.argmax(1)
    best, whole = total[rows, k], total.sum(1)
    return k, best, np.where(whole > 0, best / np.maximum(whole, 1e-9), 0.0), hits[rows, k]


def _marks(lists: pa.Array, classes: int) -> np.ndarray:
    out = np.zeros((len(lists), classes), bool)
    values, where = _flat(lists)
    out[where, values] = True
    return out


def _counter(rules: Rules | None, classes: int):
    """Partial counts of rows (items, classes): code, n, and n per class; of single items, or of extensions of the open patterns of ``rules``. Code -1 counts all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = _marks(batch.column(1), classes)
            codes, row = _flat(batch.column(0))
            codes = codes.astype(np.int64)
            if rules is not None:
                *_, (row, _, _, codes) = rules.found(codes, row)
            unique, inverse = np.unique(codes, return_inverse=True)
            n = np.bincount(inverse, minlength=len(unique))
            per_class = [np.bincount(inverse, marks[row, k], len(unique)).astype(np.int64) for k in range(classes)]
            columns = [np.r_[-1, unique], np.r_[batch.num_rows, n], *[np.r_[marks[:, k].sum(), c] for k, c in enumerate(per_class)]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["code", "n", *[f"c{k}" for k in range(classes)]])

    return run


def _mine(used: DataFrame, classes: int, rules: Rules | None, support: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes with their number of rows, and of rows per class, where a class has at least the share ``least``; the totals."""
    names = ["n", *[f"c{k}" for k in range(classes)]]
    partial = used.mapInArrow(_counter(rules, classes), "code bigint, " + ", ".join(f"{c} bigint" for c in names))
    sums = partial.groupBy("code").agg(*[F.sum(c).alias(c) for c in names])
    most = F.greatest(*[F.col(c) for c in names[1:]]) if classes > 1 else F.col("c0")
    rows = sums.where((F.col("code") == -1) | ((F.col("n") >= support) & (most >= least * F.col("n")))).toPandas().to_numpy()
    head = rows[rows[:, 0] == -1]
    totals = head[0, 1:] if len(head) else np.zeros(classes + 1)
    rows = rows[rows[:, 0] >= 0]
    rows = rows[np.argsort(rows[:, 0])]
    return rows[:, 0].astype(np.int64), rows[:, 1].astype(float), rows[:, 2:].astype(float), totals


def _confidence(n: np.ndarray, by_class: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best class, its smoothed confidence, and its weight: the log odds beyond those of the prior."""
    conf = (by_class + prior) / (n + 1)[:, None]
    k = conf.argmax(1) if len(conf) else np.zeros(0, int)
    best = np.clip(conf[np.arange(len(conf)), k], 1e-6, 1 - 1e-6)
    return k, best, np.log(best / (1 - best)) - np.log(prior[k] / (1 - prior[k]))


def mine_rules(used: DataFrame, classes: int, n_items: int, share: float, least_support: int = 3, confidence: float = 0.7, hint: float = 0.35, gain: float = 0.1) -> Rules:
    """Class-association rules of ``used`` (items array<int>, classes array<int>) by parallel pattern growth.

    Frequent items are counted with the classes. Each level then projects the rows on the open patterns (their
    conditional bases) and counts the items that follow, in the order of frequency, with a combining aggregate: no task
    holds the tree of a frequent item, however many rows have it. A pattern of at least ``confidence`` for a class is a rule, and
    isn't grown, as longer rules would be redundant beside it. Another is grown only if it hints at a class
    (``hint``), and from the second item on if it is ``gain`` surer of it than the shorter pattern, until none is left; no length is fixed.

    Patterns in fewer than ``share`` of the rows (but ``least_support`` at least) aren't frequent, so their number, which is what the
    driver sees and tasks get, is at most the patterns of a mean row / ``share``, whatever the number of rows.
    """
    support = max(least_support, math.ceil(share * used.count()))
    codes, n, by_class, totals = _mine(used, classes, None, support, hint * 0.8)
    prior = np.clip(totals[1:] / max(1, totals[0]), 0.005, 0.6)
    k, conf, weight = _confidence(n, by_class, prior)
    rules = Rules(classes, n_items, np.full(n_items, -1), np.zeros(n_items), np.zeros(n_items, bool))
    strong = (conf >= confidence) & (weight > 0)
    rules.item_class[codes[strong]], rules.item_weight[codes[strong]] = k[strong], weight[strong]
    hints = (by_class + prior) / (n + 1)[:, None] >= np.maximum(hint, 2 * prior)
    rules.grown[codes[~strong & hints.any(1)]] = True
    shorter = np.zeros((n_items, classes))
    shorter[codes] = (by_class + prior) / (n + 1)[:, None]
    going = rules.grown.any()
    while going:
        codes, n, by_class, _ = _mine(used, classes, rules, support, hint)
        k, conf, weight = _confidence(n, by_class, prior)
        strong = (conf >= confidence) & (weight > 0)
        open_ = ~strong & (conf >= shorter[codes // n_items, k] + gain)
        kept = strong | open_
        rules.levels.append(Level(codes[kept], np.where(strong, k, -1)[kept], weight[kept], open_[kept]))
        shorter, going = ((by_class + prior) / (n + 1)[:, None])[kept], open_.any()
    return rules


@dataclass
class Calibration:
    """The chance that the best class is right, from its evidence, its share and its number of rules: logistic, fitted on labelled documents."""

    coefficients: np.ndarray

    @staticmethod
    def features(best: np.ndarray, share: np.ndarray, hits: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(best)), np.log1p(best), share, np.log1p(np.minimum(hits, 9))], 1)

    def chance(self, best: np.ndarray, share: np.ndarray, hits: np.ndarray) -> np.ndarray:
        return np.where(hits > 0, 1 / (1 + np.exp(-np.clip(self.features(best, share, hits) @ self.coefficients, -30, 30))), 0.0)


def _expanded(batch: pa.RecordBatch, classes: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Items of the paragraphs of labelled documents, the document of each, and its labels."""
    parts = batch.column(2)
    doc = pc.list_parent_indices(parts).to_numpy()
    return parts.flatten(), doc, _marks(batch.column(1), classes)[doc]


def _calibrate(labelled: DataFrame, rules: Rules) -> Calibration:
    """The best classes of labelled paragraphs are counted in a grid of evidence, share and number of rules: 41 * 21 * 10 * 2 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, _, marks = _expanded(batch, rules.classes)
            ids, row = _flat(lists)
            k, best, share, n = _best(*rules.evidence(ids, row, len(lists)))
            right = marks[np.arange(len(lists)), k]
            m = n > 0
            columns = (np.minimum(40, np.log1p(best[m]) * 5), share[m] * 20, np.minimum(9, n[m]), right[m])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in columns], ["b", "s", "h", "y"])

    grid = labelled.mapInArrow(run, "b int, s int, h int, y int").groupBy("b", "s", "h", "y").count().toPandas()
    start = np.array([-3.0, 1.0, 3.0, 0.5])
    w = start.copy()
    if len(grid):
        x = Calibration.features(np.expm1((grid["b"].to_numpy() + 0.5) / 5), (grid["s"].to_numpy() + 0.5) / 20, grid["h"].to_numpy())
        y, n = grid["y"].to_numpy(float), grid["count"].to_numpy(float)
        for _ in range(30):  # Newton's steps with a weak prior towards the start
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (y - p)) - 0.5 * (w - start)
            w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(4), slope)
    return Calibration(w)


def _clear(rules: Rules, ids: np.ndarray, row: np.ndarray, rows: int, sure: float, share: float = 0.8, least_hits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have one clear class to learn from, and the best class of each."""
    k, best, part, n = _best(*rules.evidence(ids, row, rows))
    return (best >= sure) & (n >= least_hits) & (part >= share), k


_USED = "items array<int>, classes array<int>"


def _singles(k: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32)), pa.array(k.astype(np.int32)))


def _sure_rows(rules: Rules, sure: float) -> Callable:
    """Paragraphs with one clear class have it; the others aren't used: words that no rule knows yet must not count against a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = _flat(batch.column(3))
            clear, k = _clear(rules, ids, row, batch.num_rows, sure)
            yield pa.RecordBatch.from_arrays([batch.column(3).filter(pa.array(clear)), _singles(k[clear])], ["items", "classes"])

    return run


def _hand_rows(rules: Rules | None, classes: int, sure: float) -> Callable:
    """Paragraphs of hand-labelled documents: with all labels, or (given rules) those without a clear class with the labels that no other paragraph of the document explains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, doc, marks = _expanded(batch, classes)
            used = np.ones(len(lists), bool)
            if rules is not None:
                ids, row = _flat(lists)
                clear, k = _clear(rules, ids, row, len(lists), sure)
                explained = np.zeros((batch.num_rows, classes), bool)
                explained[doc[clear], k[clear]] = True
                marks &= ~explained[doc]
                used = ~clear & marks.any(1)
            where, values = np.nonzero(marks[used])
            offsets = np.r_[0, np.cumsum(np.bincount(where, minlength=int(used.sum())))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([lists.filter(pa.array(used)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))], ["items", "classes"])

    return run


def paragraph_subjects(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, subjects: list[str], rounds: int = 6, share: float = 3e-5, least_support: int = 3, chance: float = 0.5, least_hits: int = 3, sure: float = 6.0, settled: float = 0.02
) -> DataFrame:
    """(doc_id, para, size, subject, chance) of each paragraph that is mainly about a subject.

    Rules are mined from the paragraphs of the labelled documents (each with all labels of its
    document), then from all paragraphs that the rules before are sure of (evidence of ``sure`` from three rules at least, 0.8 of all of it for one class), so
    that words which no labelled document holds are learned, too; and from the other
    paragraphs of labelled documents with the labels that nothing explains yet; until a round changes at most the share ``settled`` of the rules
    (or after ``rounds``). A paragraph gets its best class if the calibrated chance, for which the number of matching rules counts, reaches ``chance``
    and ``least_hits`` rules match: languages with few labels have words that are rules by accident, and a single such word isn't enough.

    Items are frequent from ``share`` of all paragraphs, or of those of labelled documents, on (and ``least_support`` of them at least), so there are at
    most 2 * (items per paragraph) / ``share``: these, and the rules (see ``mine_rules``), are what
    the driver sees and the tasks get. Null and blank texts have no paragraphs; labels that
    aren't in ``subjects`` (any case, blanks around) or of unknown documents are ignored, repeated
    labels count once; a null doc_id is a document; no labels at all give no rows; ties go to
    the subject named first; other columns aren't read.
    """
    scratch, n_classes = Scratch(spark, "subjects"), len(subjects)
    texts = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    raw = scratch.write(texts.mapInArrow(_transactions, _ROW), "items")
    names = spark.createDataFrame(list(enumerate(subjects)), "class int, subject string")
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("subject")).alias("subject")).join(F.broadcast(names), "subject")
    marked = marked.groupBy("doc_id").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    hand = scratch.write(texts.join(marked, "doc_id").mapInArrow(_labelled_documents, "doc_id bigint, classes array<int>, parts array<array<bigint>>"), "hand")

    def frequent(items: DataFrame, rows: int) -> DataFrame:
        return items.groupBy("item").count().where(F.col("count") >= max(least_support, math.ceil(share * rows)))

    everywhere = frequent(raw.select(F.explode("items").alias("item")), raw.count())
    in_hand = frequent(hand.select(F.explode(F.flatten("parts")).alias("item")), hand.agg(F.coalesce(F.sum(F.size("parts")), F.lit(0))).first()[0])
    counted = everywhere.unionByName(in_hand).groupBy("item").agg(F.max("count").alias("count")).toPandas()
    # The list of frequent items: most frequent first.
    order = np.lexsort((counted["item"].to_numpy(np.int64), -counted["count"].to_numpy(np.int64)))
    listed = counted["item"].to_numpy(np.int64)[order]
    by_code = np.argsort(listed)
    data = scratch.write(raw.mapInArrow(_encoder(listed[by_code], by_code), _ROW.replace("bigint>", "int>")), "frequent")
    labelled = scratch.write(hand.mapInArrow(_document_encoder(listed[by_code], by_code), "doc_id bigint, classes array<int>, parts array<array<int>>"), "labelled")
    scratch.drop(raw, hand)
    n_items = max(1, len(listed))
    rules = mine_rules(scratch.write(labelled.mapInArrow(_hand_rows(None, n_classes, sure), _USED), "used"), n_classes, n_items, share, least_support)
    for _ in range(rounds):
        before = rules
        used = data.mapInArrow(_sure_rows(rules, sure), _USED).unionByName(labelled.mapInArrow(_hand_rows(rules, n_classes, sure), _USED))
        used = scratch.write(used, "used")
        rules = mine_rules(used, n_classes, n_items, share, least_support)
        scratch.drop(used)
        if rules.changed(before) <= settled:
            break
    calibration = _calibrate(labelled, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row = _flat(batch.column(3))
            k, best, part, n = _best(*rules.evidence(ids, row, batch.num_rows))
            p = calibration.chance(best, part, n)
            m = pa.array((p >= chance) & (n >= least_hits))
            chosen = pa.array([subjects[i] for i in k], pa.string())
            yield pa.RecordBatch.from_arrays([*[c.filter(m) for c in batch.columns[:3]], chosen.filter(m), pa.array(p).filter(m)], ["doc_id", "para", "size", "subject", "chance"])

    return data.mapInArrow(run, "doc_id bigint, para int, size int, subject string, chance double")
