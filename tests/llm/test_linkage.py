import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanforge.llm import linkage
from spanforge.llm.linkage import History, Weights, link_batches, original_file, overlay_records

SCHEMA = "overlay_id long, batch_no int, source string, source_image string, source_sha256 string, phash_int long, key int, h int, id int"


def digest(i):
    return f"{i + 1:064x}"


def brute(rows):
    accepted, links = [], set()
    for r in sorted(set(rows), key=lambda r: (r[1], r[0])):
        hits = [a[0] for a in accepted if (r[4] and r[4] == a[4]) or (r[5] and a[5] and ((r[5] ^ a[5]) & (2**64 - 1)).bit_count() <= 4) or (r[2] and r[3] and (r[2], r[3]) == (a[2], a[3]))]
        links |= {(r[0], a) for a in hits}
        if not hits:
            accepted.append(r)
    return links


def sample(n, seed):
    random.seed(seed)
    bases = [random.getrandbits(63) for _ in range(12)]
    rows = []
    for i in range(n):
        h = random.choice(bases) ^ sum(1 << b for b in random.sample(range(60), random.randrange(0, 5))) if i % 3 else random.getrandbits(63)
        file = f"IMG_{random.randrange(n):08d}.jpg" if i % 2 else None
        rows.append((i, random.randrange(6), random.choice(["ds", "ds2", None]), file, digest(random.randrange(n)) if i % 4 else (digest(0) if i % 8 else None), h if i % 5 else None))
    return rows + rows[:5]


@pytest.mark.parametrize(("calls", "seed"), [(2, 2), (10, 1)])
def test_any_number_of_batches_a_call(spark, calls, seed):
    rows = sample(160, seed)
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)
    history, links = link_batches(spark, df, calls)
    wanted = brute(rows)
    assert {(r["id"], r["accepted_id"]) for r in links.collect()} == wanted
    if calls == 2:
        got = history.clusters().collect()
        assert sorted(r["id"] for r in got) == list(range(160))
        cluster = {r["id"]: r["cluster_id"] for r in got}
        assert all(cluster[a] == cluster[b] for a, b in wanted)
        groups = {i: i for i in range(160)}  # by passing minima on
        changed = True
        while changed:
            changed = False
            for a, b in wanted:
                low = min(groups[a], groups[b])
                changed |= groups[a] != low or groups[b] != low
                groups[a] = groups[b] = low
        assert len(set(cluster.values())) == len(set(groups.values()))


def test_odd_rows(spark):
    rows = [(1, 1, None, None, None, None), (2, 1, "?", "IMG_00000001.jpg", "n/a", 0), (3, None, None, "x.jpg", None, None), (None, 1, "ds", None, digest(1), 5), (4, 2, "DS ", "a/img_00000001 - Copy.PNG", None, None), (5, 3, "ds", "b\\IMG_00000001(3).tif", None, None)]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)
    _, links = link_batches(spark, df)
    assert [(r["id"], r["accepted_id"]) for r in links.collect()] == [(5, 4)]
    assert link_batches(spark, df.limit(0))[1].collect() == []
    assert overlay_records(df).count() == 5


@pytest.mark.parametrize(("path", "wanted"), [("batch_a/TWR_00003691.jpg", "twr_00003691"), ("D:\\survey\\SPAN_00005955 - Copy.BMP", "span_00005955"), ("copy of IMG_00000001@2x.jpg", "img_00000001"), ("IMG_00000001_640x640.jpg", "img_00000001"), ("IMG_1.jpg", None), (None, None), ("", None)])
def test_original_file(spark, path, wanted):
    assert spark.createDataFrame([(path,)], "p string").select(original_file(F.col("p"))).first()[0] == wanted


def test_weights():
    w = Weights(Counter({(1, 3, None, 1): 80, (0, 0, 0, 1): 300, (0, 2, 1, 1): 40, (None, 0, 0, 0): 500, (0, 1, 0, 1): 30}))
    assert w.grades[0][1] > 0 > w.grades[0][0] and w.grades[0][1] > w.grades[3][1]
    score = lambda *g: sum(w.grades[k][x] for k, x in enumerate(g) if x is not None)
    assert min(score(1, 0, 0, 0), score(0, 2, 0, 0), score(0, 0, 1, 1)) > w.threshold > max(score(0, 0, 0, 1), score(None, 1, None, 0))
    assert Weights(Counter()).threshold is not None


def test_the_score_decides(spark, monkeypatch):
    """With the weights of two fields exchanged other pairs are linked."""
    rows = sample(160, 1)
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)
    plain = Weights.__init__

    def shuffled(self, *args, **kw):
        plain(self, *args, **kw)
        self.grades = [x[::-1] for x in self.grades]

    monkeypatch.setattr(Weights, "__init__", shuffled)
    assert {(r["id"], r["accepted_id"]) for r in link_batches(spark, df)[1].collect()} != brute(rows)


def test_a_history_is_opened_again(spark, tmp_path):
    rows = sample(160, 2)
    records = overlay_records(spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA))
    path = f"file://{tmp_path}/history"
    got = {(r["id"], r["accepted_id"]) for at in range(6) for r in History(spark, path).ingest(records.where(F.col("batch") == at)).collect()}
    assert got == brute(rows)
    again = History(spark, path)
    assert again.clusters().count() == 160 and again.size == again.accepted().count()
    # what a call that died has left isn't read
    again._append(again.accepted().limit(3).withColumn("id", F.col("id") + 1000), "accepted", 7)
    assert History(spark, path).accepted().count() == again.size


def test_longer_keys_for_a_grown_history(spark, monkeypatch):
    monkeypatch.setattr(linkage, "RUNGS", ((2, 2, 60), (3, 3, 100), (4, 4, 2**62)))
    rows = sample(160, 1)
    history, links = link_batches(spark, spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA), 1)
    assert {(r["id"], r["accepted_id"]) for r in links.collect()} == brute(rows) and history.rung > 0
