import random

import pyarrow as pa
import pytest

from spanforge.llm import consensus
from spanforge.llm import queries
from spanforge.llm.consensus import closest_to_consensus, consensus_survivors

SCHEMA = "g string, v string, trust int, at int, id long, _n int, place int"


def pick(values, weights=None):
    return closest_to_consensus(values, weights or [1.0] * len(values))


def test_votes():
    assert pick(["Skarn Q4", "Skarm Q4", "Skarn Q4"]) == 0
    assert pick(["a-b-x", "a-b-c", "a-b-c"]) == 1
    assert pick(["a-b-x", "a-b-c", "a-b-c"], [5, 1, 1]) == 0
    assert pick(["images/test/x.jpg", "images/x.jpg", "./images/test/x.jpg", "images/test/x.jpg"]) == 0
    assert pick(["", "a", ""]) == 0 and pick(["one"]) == 0
    assert pick(["a", "b"]) == 0  # a tie


def test_halving_weights_follow_the_order():
    random.seed(1)
    for _ in range(200):
        values = ["".join(random.choice(["ab", "1", "/", " ", "x"]) for _ in range(random.randrange(1, 7))) for _ in range(random.randrange(1, 70))]
        assert values[pick(values, [0.5**i for i in range(1, len(values) + 1)])] == values[0]


def test_long_values(monkeypatch):
    monkeypatch.setattr(consensus, "CELLS", 50)
    assert pick(["a " * 300 + "x", "b " * 300 + "y", "a " * 300 + "x"], [1, 1, 1]) == 0


def test_alignments_are_the_best_at_any_size(monkeypatch):
    """Loops, arrays and cuts in two find as many matches as the plain recurrence."""
    random.seed(3)
    for _ in range(60):
        columns = [{t: random.randrange(1, 4) for t in random.sample("abcde", random.randrange(1, 3))} for _ in range(random.randrange(0, 14))]
        row = [random.choice("abcdef") for _ in range(random.randrange(0, 14))]
        worth = set()
        for few, cells in ((2000, 10**6), (0, 10**6), (2000, 9), (0, 9)):
            monkeypatch.setattr(consensus, "FEW_CELLS", few)
            monkeypatch.setattr(consensus, "CELLS", cells)
            steps = consensus._align(columns, row)
            assert [c for c, _ in steps if c >= 0] == list(range(len(columns))) and [t for _, t in steps if t >= 0] == list(range(len(row)))
            worth.add(sum(columns[c].get(row[t], 0) for c, t in steps if c >= 0 and t >= 0))
        best = [[0] * (len(row) + 1) for _ in range(len(columns) + 1)]
        for i, column in enumerate(columns):
            for j, t in enumerate(row):
                best[i + 1][j + 1] = max(best[i][j] + column.get(t, 0), best[i][j + 1], best[i + 1][j])
        assert worth == {best[-1][-1]}


def test_votes_beat_the_most_trusted(spark):
    rows = [("g", "Skarm Q4", 9, 0, 0, 5), ("g", "Skarn Q4", 3, 0, 1, 3), ("g", "Skarn Q4b", 2, 0, 2, 3), ("h", "only", 1, 0, 3, None), ("h", None, 9, 0, 4, 9)]
    df = spark.createDataFrame(rows, "g string, v string, trust int, at int, id long, w int")
    assert {r["g"]: r["v"] for r in consensus_survivors(spark, df, ["g"], "v", ["trust", "at", "id"], weight="w").collect()} == {"g": "Skarn Q4", "h": "only"}
    assert {r["g"]: r["v"] for r in consensus_survivors(spark, df, ["g"], "v", ["trust", "at", "id"]).collect()} == {"g": "Skarm Q4", "h": "only"}


@pytest.mark.parametrize("chunk", [2, 64])
def test_survivors(spark, chunk):
    rows = [("g", None, 9, 1, 1), ("g", "b", 1, 5, 2), ("g", "c", 1, 6, 3), ("g", "c", 0, 9, 4), ("h", None, 1, 1, 5), (None, "n", None, None, 6), (None, "m", 0, None, 7), ("t", "z", 1, None, 9), ("t", "y", 1, 3, 8)]
    rows += [("hot", f"v{i} x", 1, i, 100 + i) for i in range(150)] + [("g", "c", 1, 6, 3)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    got = consensus_survivors(spark, df, ["g"], "v", ["trust", "at", "id"], chunk)
    assert {r["g"]: (r["v"], r["id"]) for r in got.collect()} == {"g": ("c", 3), None: ("m", 7), "t": ("y", 8), "hot": ("v149 x", 249)}
    assert consensus_survivors(spark, df.limit(0), ["g"], "v", ["trust", "at", "id"]).collect() == []


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strict_trust_takes_no_votes(spark, sf_dir):
    """No alignment where the order alone decides, and the rows are those that votes halving along it give."""
    random.seed(5)
    groups = {g: [" ".join(random.choices("abc1", k=4)) + f" x{i}" for i in range(n)] for g, n in (("one", 1), ("few", 5), ("many", 90))}
    rows = [(g, v, 1, -i, i, 0, 0) for g, vs in groups.items() for i, v in enumerate(vs)] * 2
    got = consensus_survivors(spark, spark.createDataFrame(rows, SCHEMA), ["g"], "v", ["trust", "at", "id"])
    assert sorted((r["g"], r["v"]) for r in got.collect()) == sorted((g, vs[pick(vs, [1 << i for i in reversed(range(len(vs)))])]) for g, vs in groups.items())
    assert "MapInArrow" not in plan(got)
    assert "MapInArrow" not in plan(queries.p6_found(spark, sf_dir)) and "MapInArrow" not in plan(queries.p6_survivors(spark, sf_dir))
    assert "MapInArrow" in plan(queries.p6_consensus(spark, sf_dir))


def test_weights_of_large_parts_are_exact():
    # all but the most trusted value share a token in a column that it lacks
    values = ["a"] + [f"a b{chr(97 + i // 26)}{chr(97 + i % 26)} x" for i in range(119)]
    batch = pa.RecordBatch.from_arrays([pa.array([values]), pa.array([None], pa.list_(pa.int64())), pa.array([1])], ["v", "w", "k"])
    assert [b.column("place").to_pylist() for b in consensus._winners(iter([batch]))] == [[1]]
    columns = ["a"] + ["a x"] * 119
    assert closest_to_consensus(columns, [1 << i for i in reversed(range(120))]) == 0
