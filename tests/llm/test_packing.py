import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanforge.llm.packing import best_fit, pack, pack_all, pack_checks, pack_report
from spanforge.llm.tokens import cut, encoding, TOKENIZER

SCHEMA = "doc_id long, text string, source string, part int, tokens int, cluster int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 4), st.integers(1, 3)), max_size=60))
def test_best_fit(items):
    sizes, clusters, sources = [i[0] for i in items], [i[1] for i in items], [i[2] for i in items]
    bins = best_fit(sizes, 20, clusters, sources, {1: 1 << 2, 2: 1 << 1})
    held = {}
    for i, b in enumerate(bins):
        held.setdefault(b, []).append(i)
    for members in held.values():
        assert sum(sizes[i] for i in members) <= 20 or len(members) == 1
        assert len({clusters[i] for i in members}) == len(members)
        assert not {1, 2} <= {sources[i] for i in members}


def test_tightest_bin():
    # bins are left with 4 and 6; the 4 goes where nothing remains
    assert best_fit([16, 14, 4], 20, [0, 1, 2], [0, 0, 0], {}) == [0, 1, 0]
    # ... unless its copy is there
    assert best_fit([16, 14, 4], 20, [2, 1, 2], [0, 0, 0], {}) in ([0, 1, 1], [0, 1, 2])
    assert best_fit([], 20, [], [], {}) == [] and best_fit([50], 20, [0], [0], {}) == [0]


@pytest.mark.parametrize("text", ["", "a", "word " * 500, "đường dây 😀" * 200, "x" * 3000, "\n\t " * 400])
def test_cut_round_trip(text):
    enc = encoding(TOKENIZER)
    parts = cut(text, 32)
    assert "".join(text[a:b] for a, b, _ in parts) == text
    assert all(n == len(enc.encode_ordinary(text[a:b])) <= 32 for a, b, n in parts)
    if len(enc.encode_ordinary(text)) <= 32:
        assert len(parts) <= 1


def test_copies_of_a_third():
    sizes, clusters = [4] * 100 + [12] * 100, [7] * 100 + list(range(100, 200))
    assert len(set(best_fit(sizes, 16, clusters, [0] * 200, {}))) == 100


def test_pack(spark):
    random.seed(2)
    docs = [(i, " ".join(random.choice(["line", "pole", "nest", "ice"]) for _ in range(random.randrange(1, 50))), random.choice(["a", "B ", None])) for i in range(300)]
    docs += [(300 + i, "the same text again", "a") for i in range(40)] + [(400, "long " * 400, "a"), (401, None, "a"), (402, "", "a"), (403, "  ", None), (None, "no id", None)]
    docs += docs[:3]
    df = spark.createDataFrame([(*d, 0, 0, 0) for d in docs], SCHEMA)
    rows = pack(spark, df, 64, apart=[("a", "b")], per_task=60).collect()
    packs = {}
    for r in rows:
        packs.setdefault(r["pack_id"], []).append(r)
    for members in packs.values():
        assert sum(r["tokens"] for r in members) <= 64
        assert not {"a", "b"} <= {r["source"] for r in members}
        assert sum(300 <= (r["doc_id"] or 0) < 340 for r in members) <= 1
    whole = {r["doc_id"] for r in rows}
    assert whole == {d[0] for d in docs} - {401, 402}
    assert {r["doc_id"] for r in rows if r["n_pieces"] > 1} == {400}
    assert len(rows) == len({(r["doc_id"], r["piece"]) for r in rows})
    assert pack_report(pack(spark, df, 64), 64).first()["filled"] > 0.85
    assert pack(spark, df.limit(0), 64).collect() == []


def test_several_sizes_at_once(spark):
    random.seed(5)
    docs = [(i, "pole " * random.randrange(1, 90), random.choice(["a", "b", "c"])) for i in range(200)]
    df = spark.createDataFrame([(*d, 0, 0, 0) for d in docs], SCHEMA)
    sizes = {"s": 32, "l": 100}
    both = pack_all(spark, df, sizes, apart=[("a", "b")], per_task=50)
    for r in pack_checks(both, sizes, [("a", "b")]).collect():
        assert r["n_docs"] == 200 and r["n_overfull"] == r["n_small_divided"] == r["n_pieces_lost"] == r["n_copies_together"] == r["n_sources_together"] == 0
    assert any(r["n_sources_together"] for r in pack_checks(pack_all(spark, df, sizes), sizes, [("a", "b")]).collect())
