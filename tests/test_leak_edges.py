from spanforge.plans.duplicates import leak_components, leak_edges, leak_edges_of


def test_strong_needs_both_hashes(spark):
    v = [1.0, 0.0]
    rows = [(1, 0, 0, v), (2, 1, 0b111111, v), (3, 3, 0b1111111, v), (4, 0xFFFFFF, 0b11, v), (5, 0xFFF000, 0xFFFFFF, v), (6, 0, 0, [0.25, 0.9])]
    df = spark.createDataFrame(rows, "vec_id long, hash long, second long, embedding array<double>")
    got = {(r["a"], r["b"]): (r["kind"], r["h1"], r["h2"]) for r in leak_edges_of(df).collect()}
    want = {}
    for a, h, s, e in rows:
        for b, k, t, f in rows:
            h1, h2, cos = (h ^ k).bit_count(), (s ^ t).bit_count(), sum(x * y for x, y in zip(e, f))
            if a < b and (h1 <= 6 or h2 <= 6) and cos >= 0.2:
                want[a, b] = ("strong" if h1 <= 4 and h2 <= 6 and cos >= 0.35 else "review", h1, h2)
    assert got == want
    assert got[1, 2][0] == "strong" and got[1, 3] == ("review", 2, 7) and got[1, 4] == ("review", 24, 2) and got[1, 6][0] == "review"


def test_components_of_strong_edges(spark, sf_dir):
    strong = leak_edges(spark, sf_dir).where("kind = 'strong'").collect()
    assert all(r["h1"] <= 4 and r["h2"] <= 6 and r["cosine"] >= 0.35 for r in strong)
    ends = {x for r in strong for x in (r["a"], r["b"])}
    assert {r["vec_id"] for r in leak_components(spark, sf_dir).collect()} == ends
