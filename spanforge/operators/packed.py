"""Fields that hold several values: one row per value, with its position.

The work is done on the buffers of Arrow string columns with NumPy masks over all bytes of
a batch: quote parity, delimiters, child offsets, then a list array that is flattened with
the ordinals of its parents. No cell is looked at one by one, but for values with JSON
escapes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANKS = b" \t\r\n\x0b\x0c"
_BRACKETS = {ord("["): ord("]"), ord("{"): ord("}"), ord("("): ord(")")}


@dataclass(frozen=True)
class Packing:
    """How the cells of a field are packed.

    delimiters: each separates two values, and two of them hold an empty place.
    blank: a run of blanks separates, too, unless it stands beside a delimiter.
    """

    delimiters: str
    blank: bool = False


def _lut(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_IS_BLANK = _lut(_BLANKS)


def split_cells(cells: pa.Array, packing: Packing) -> tuple[pa.ListArray, pa.Array]:
    """The values of each cell as a list array (null: an empty place), and the number of places.

    * null, empty and blank cells, and a bare pair of brackets, have no places;
    * ``[]``, ``{}`` or ``()`` around the whole cell are dropped; in square brackets a backslash
      escapes as in JSON, elsewhere a doubled quote stands for one inside quotes;
    * a last quote without a partner is an ordinary character.
    """
    cells = cells.cast(pa.large_string())
    rows = len(cells)
    offsets = np.frombuffer(cells.buffers()[1], np.int64, rows + 1, cells.offset * 8) if rows else np.zeros(1, np.int64)
    raw = cells.buffers()[2]
    base = int(offsets[0])
    text = np.frombuffer(raw, np.uint8, int(offsets[-1]) - base, base) if raw is not None and offsets[-1] > base else np.zeros(0, np.uint8)
    offsets = offsets - base
    n = len(text)
    if not n:
        return pa.ListArray.from_arrays(pa.array(np.zeros(rows + 1, np.int32)), pa.array([], pa.string())), pa.array(np.zeros(rows, np.int32))

    at = np.arange(n)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    row_start = offsets[row]
    delimiter_table = _lut(packing.delimiters.encode())
    blank = _IS_BLANK[text]
    # A blank that delimits isn't trimmed off the ends of a cell.
    solid = np.flatnonzero(~blank | delimiter_table[text])
    begin, end = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if len(solid):
        owner = row[solid]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        begin[owner[first]] = solid[first]
        end[owner[first]] = solid[np.r_[first[1:] - 1, len(solid) - 1]] + 1

    # Brackets of the whole cell.
    filled = np.flatnonzero(end - begin >= 2)
    json_row = np.zeros(rows, bool)
    for left, right in _BRACKETS.items():
        maybe = filled[(text[begin[filled]] == left) & (text[end[filled] - 1] == right)]
        if len(maybe):
            opened = np.bincount(row[text == left], minlength=rows)
            maybe = maybe[(opened[maybe] == 1) | ((left == ord("[")) & (text[begin[maybe] + 1] == 34))]
            begin[maybe] += 1
            end[maybe] -= 1
            if left == ord("["):
                json_row[maybe] = True

    # Quotes, without the escaped ones; inside: parity of the quotes so far in the row.
    quote = text == 34
    if json_row.any():
        slash = (text == 92) & json_row[row]
        last_other = np.maximum.accumulate(np.where(slash, -1, at))
        before = np.r_[-1, last_other[:-1]]
        escaped = (at - 1 - np.maximum(before, row_start - 1)) % 2 == 1
        quote &= ~(escaped & json_row[row])
    in_cell = (at >= begin[row]) & (at < end[row])
    quote &= in_cell
    count = np.bincount(row[quote], minlength=rows)
    odd = np.flatnonzero(count % 2)
    if len(odd):
        marks = np.flatnonzero(quote)
        last = np.r_[row[marks][1:] != row[marks][:-1], True]
        lonely = marks[last & np.isin(row[marks], odd)]
        quote[lonely] = False
    running = np.cumsum(quote)
    first_byte = np.minimum(row_start, n - 1)
    parity = running - (running[first_byte] - quote[first_byte])
    inside = parity % 2 == 1

    mark = delimiter_table[text] & in_cell & ~inside
    # Next and previous byte that isn't blank (n and -1: none); those that delimit count as solid.
    firm = ~blank | mark | inside
    nearest_next = np.minimum.accumulate(np.where(firm, at, n)[::-1])[::-1]
    nearest_before = np.maximum.accumulate(np.where(firm, at, -1))
    if packing.blank:
        run = in_cell & ~inside & blank & ~mark
        head = run & ~np.r_[False, run[:-1]]
        heads = np.flatnonzero(head)
        if len(heads):
            left, right = nearest_before[heads], nearest_next[heads]
            good = (left >= begin[row[heads]]) & (right < end[row[heads]])
            good[good] &= ~mark[left[good]] & ~mark[right[good]]
            mark[heads[good]] = True

    # Places: one more than delimiters in each cell that isn't empty.
    alive = np.flatnonzero(_not_blank(begin, end, nearest_next))
    cuts = np.flatnonzero(mark & np.isin(row, alive, kind="table")) if len(alive) else np.zeros(0, np.int64)
    # Cuts come first: an empty last place starts where the next cell begins.
    starts = np.concatenate([cuts + 1, begin[alive]])
    order = np.argsort(starts, kind="stable")
    starts = starts[order]
    owner = np.concatenate([row[cuts], alive])[order]
    stops = np.r_[starts[1:] - 1, 0]
    last_of_row = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.zeros(0, bool)
    stops = np.where(last_of_row, end[owner], stops) if len(owner) else starts

    # Trim blanks, then quotes, then blanks inside the quotes.
    starts, stops = _trim(starts, stops, ~blank, n)
    quoted = (stops - starts >= 2) & quote[np.minimum(starts, n - 1)] & quote[np.maximum(stops - 1, 0)]
    starts, stops = starts + quoted, stops - quoted
    starts, stops = _trim(starts, stops, ~blank, n)
    empty = stops <= starts

    # Bytes that stay: those of the values, with one of each doubled quote inside quotes.
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts[~empty], 1)
    np.add.at(edge, stops[~empty], -1)
    keep = np.cumsum(edge[:n]) > 0
    doubled = quote & keep
    if doubled.any():
        place = np.searchsorted(starts, np.flatnonzero(doubled), "right") - 1
        marks = np.flatnonzero(doubled)
        first_of = np.r_[True, place[1:] != place[:-1]]
        ordinal = np.arange(len(marks)) - np.maximum.accumulate(np.where(first_of, np.arange(len(marks)), 0))
        drop = quoted[place] & ~json_row[owner[place]] & (ordinal % 2 == 1)
        keep[marks[drop]] = False
    kept = np.r_[0, np.cumsum(keep)]
    sizes = np.where(empty, 0, kept[np.maximum(stops, starts)] - kept[starts])
    child = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    values = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(child.tobytes()), pa.py_buffer(text[keep].tobytes())])
    values = pc.if_else(pa.array(empty), pa.scalar(None, pa.large_string()), values)
    slashed = np.flatnonzero(json_row[owner] & quoted & ~empty) if len(owner) else np.zeros(0, np.int64)
    if len(slashed):
        slashed = slashed[pc.match_substring(values.take(pa.array(slashed)), "\\").to_numpy(zero_copy_only=False)]
    if len(slashed):
        fixed = [_json_text(x) for x in values.take(pa.array(slashed)).to_pylist()]
        mask = np.zeros(len(values), bool)
        mask[slashed] = True
        values = pc.replace_with_mask(values, pa.array(mask), pa.array(fixed, pa.large_string()))
    places = np.bincount(owner, minlength=rows)
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(places)].astype(np.int32)), values.cast(pa.string()))
    return lists, pa.array(places.astype(np.int32))


def _not_blank(begin: np.ndarray, end: np.ndarray, nearest_next: np.ndarray) -> np.ndarray:
    there = begin < end
    out = there.copy()
    out[there] = nearest_next[begin[there]] < end[there]
    return out


def _trim(starts: np.ndarray, stops: np.ndarray, solid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(n)
    ahead = np.r_[np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1], n]
    behind = np.r_[-1, np.maximum.accumulate(np.where(solid, at, -1))]
    starts = np.minimum(ahead[np.minimum(starts, n)], np.maximum(stops, starts))
    return starts, np.maximum(behind[np.minimum(stops, n)] + 1, starts)


def _json_text(inner: str) -> str:
    try:
        return json.loads(f'"{inner}"')
    except ValueError:
        return inner


def _flat(name: str, keys: pa.Array, cells: pa.Array, packing: Packing) -> pa.RecordBatch:
    lists, places = split_cells(cells, packing)
    parents = pc.list_parent_indices(lists)
    values = lists.flatten()
    ends = np.cumsum(places.to_numpy())
    position = np.arange(len(values)) - (ends - places.to_numpy())[parents.to_numpy()] + 1 if len(values) else np.zeros(0)
    there = pc.is_valid(values)
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * pc.sum(there).as_py() if len(values) else [], pa.string()), keys.take(parents).filter(there), pa.array(position.astype(np.int32)).filter(there), values.filter(there)],
        ["field_name", "row_id", "pos", "item"],
    )


def unpack(df: DataFrame, key: str, fields: dict[str, tuple[str, Packing]]) -> DataFrame:
    """One row per value in the packed ``fields`` of ``df``.

    ``fields`` maps a column to the name it gets in ``field_name`` and its packing. The result is
    (field_name, row_id BIGINT, pos INT from 1, item). An empty place keeps its position but
    gives no row; null and blank cells give none; rows with the same key and the same cells count
    once; a null key stays null. Other columns of ``df``, whatever their names, aren't read. An
    empty table gives an empty result.
    """
    names = list(fields)
    slim = df.select(F.col(f"`{key}`").cast("bigint").alias("k"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(names)]).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, column in enumerate(names):
                label, packing = fields[column]
                yield _flat(label, batch.column(0), batch.column(i + 1), packing)

    return slim.mapInArrow(run, "field_name string, row_id bigint, pos int, item string")
