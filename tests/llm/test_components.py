import random

from spanforge.llm.components import connected_components


def union_find(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


def run(spark, edges, kind="long"):
    df = spark.createDataFrame([(a, b, 0, 0) for a, b in edges], f"a {kind}, b {kind}, u int, node int")
    rows = connected_components(spark, df).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


SHAPES = [
    [(1, 1)], [(None, 1), (2, None)], [(2, 1), (1, 2), (2, 1)],
    [(i, i + 1) for i in range(40)],  # a chain
    [(0, i) for i in range(1, 60)] + [(99, i) for i in range(50, 60)],  # two hubs
    [(i, i + 1) for i in range(0, 30, 2)] + [(5, 30), (30, 29)],
]


def test_shapes(spark):
    moved = [(None if a is None else a + 1000 * k, None if b is None else b + 1000 * k) for k, edges in enumerate(SHAPES) for a, b in edges]
    assert run(spark, moved) == union_find(moved)
    assert run(spark, []) == {}


def test_random(spark):
    random.seed(5)
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(160)]
    assert run(spark, edges) == union_find(edges)


def test_text(spark):
    assert run(spark, [("b", "c"), ("a", "b"), ("ä", "z")], "string") == {"a": "a", "b": "a", "c": "a", "z": "z", "ä": "z"}
