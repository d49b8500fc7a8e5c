import json
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.operators.packed import Packing, split_cells, unpack

NAMES, CODES = Packing(",;|/\t\n"), Packing(",;|/\t\n", blank=True)


def split(cell, packing=NAMES):
    # neighbours on both sides must not leak into the cell
    return split_cells(pa.array(['x"', cell, '"y'], pa.string()), packing)[0].to_pylist()[1]


@pytest.mark.parametrize(
    ("cell", "wanted"),
    [
        ("a,b", ["a", "b"]), (" a , b ", ["a", "b"]), ("a|b;c", ["a", "b", "c"]), ('"a, b",c', ["a, b", "c"]), ('"say ""hi"", you"', ['say "hi", you']), (",a,,b,", [None, "a", None, "b", None]),
        (None, []), ("", []), ("   ", []), ("[]", []), ("{}", []), ("[a, b]", ["a", "b"]), ("{ a | b }", ["a", "b"]), (r'["x\"y", "p\\q"]', ['x"y', r"p\q"]), ("it's, ok", ["it's", "ok"]), ('5" pipe, b', ['5" pipe', "b"]),
        ('""', [None]), ("ü,ö", ["ü", "ö"]), ("bird nest / kite", ["bird nest", "kite"]), ("a\nb\tc", ["a", "b", "c"]), (r"images\a,b", [r"images\a", "b"]), ('["ä\\u00fc"]', ["äü"]),
    ],
)
def test_cells(cell, wanted):
    assert split(cell) == wanted


@pytest.mark.parametrize(("cell", "wanted"), [("1 2", ["1", "2"]), ("1 , 2", ["1", "2"]), ("1  2 | 3", ["1", "2", "3"]), (' "1" "2" ', ["1", "2"]), ("1\t2", ["1", "2"]), ("1, , 2", ["1", None, "2"]), ("{1 2}", ["1", "2"])])
def test_blanks_that_delimit(cell, wanted):
    assert split(cell, CODES) == wanted


def slow(cell):
    """One character after another."""
    out, item, inside = [], "", False
    for c in cell:
        if c == '"':
            inside = not inside
        if c in ",;|/\t\n" and not inside:
            out.append(item)
            item = ""
        else:
            item += c
    out.append(item)
    clean = []
    for x in out:
        x = x.strip(" \t\r\n\x0b\x0c")
        if len(x) >= 2 and x[0] == x[-1] == '"':
            x = x[1:-1].replace('""', '"').strip(" \t\r\n\x0b\x0c")
        clean.append(x or None)
    return clean if cell.strip(" \r") else []


item = st.text(alphabet="ab ü'", min_size=0, max_size=4)
quoted = st.text(alphabet='ab,;| "', max_size=6).map(lambda s: '"' + s.replace('"', '""') + '"')
cells = st.lists(st.one_of(item, quoted), min_size=1, max_size=5).flatmap(lambda xs: st.sampled_from(",;|/").map(lambda d: d.join(xs)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), cells), min_size=0, max_size=6))
def test_like_one_character_after_another(rows):
    got = split_cells(pa.array(rows, pa.string()), NAMES)[0].to_pylist()
    assert got == [slow(r) if r is not None else [] for r in rows]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=6).filter(lambda s: s == s.strip() and s and not re.search(r"[\ud800-\udfff]", s)), min_size=1, max_size=5))
def test_json_round_trip(values):
    assert split(json.dumps(values)) == [v.strip(" \t\r\n\x0b\x0c") or None for v in values]


def test_slices_and_long_cells():
    long = "x" * 300_000 + "," + "y" * 300_000
    array = pa.array(["skip", long, None, "a,b"])[1:]
    assert [len(v) for v in split_cells(array, NAMES)[0].to_pylist()] == [2, 0, 2]


def test_unpack(spark):
    rows = [(1, "a,b", "1 2"), (1, "a,b", "1 2"), (2, None, ""), (None, "c", None)]
    # the names of other columns and of the result clash
    df = spark.createDataFrame([(k, x, y, "z", 0) for k, x, y in rows], "id long, p string, q string, item string, pos int")
    got = unpack(df, "id", {"p": ("t.p", NAMES), "q": ("t.q", CODES)})
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("t.p", 1, 1, "a"), ("t.p", 1, 2, "b"), ("t.q", 1, 1, "1"), ("t.q", 1, 2, "2"), ("t.p", None, 1, "c")], key=str)
    assert unpack(df.limit(0), "id", {"p": ("t.p", NAMES)}).collect() == []
