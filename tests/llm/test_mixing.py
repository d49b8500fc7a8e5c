import random

import pytest

from spanforge.llm.mixing import Mixer, mix_report

SCHEMA = "doc_id long, text string, source string, tokens int, rate double"
WORDS = {"chat": ["hello", "you", "[10:20]"], "log": ["INFO", "started", "77"], "card": ["#", "table", "rows"]}


def docs(seed=1):
    random.seed(seed)
    rows = []
    for i in range(600):
        s = "chat" if i % 2 else "log" if i % 6 else "card"
        rows.append((i, " ".join(random.choice(WORDS[s]) for _ in range(random.randrange(5, 40))), {"chat": "Chat ", "log": "log", "card": "CARD"}[s] if i % 25 else None))
    return rows + rows[:4] + [(900, None, "chat"), (901, "", "chat"), (None, "x y", "chat"), (902, "other words", "else")]


@pytest.fixture(scope="module")
def mixer(spark):
    return Mixer(spark, spark.createDataFrame([(*d, 0, 0.0) for d in docs()], SCHEMA))


def test_classifier(mixer):
    hits = [mixer.domains.names[mixer.domains.posterior(" ".join(random.choice(words) for _ in range(20))).argmax()] == name for name, words in WORDS.items() for _ in range(10)]
    assert sum(hits) >= 29


def test_shares_and_caps(spark, mixer):
    shares, caps = {"chat": 0.3, "log": 0.3, "card": 0.3, "none": 0.1}, {"chat": 1, "log": 2, "card": 4, "none": 3}
    mixed = mixer.mix(shares, caps)
    rows = mixed.collect()
    assert len(rows) == len({r["doc_id"] for r in rows})
    assert all(1 <= r["repeats"] <= caps[r["source"]] for r in rows)
    total = sum(r["repeats"] * r["tokens"] for r in rows)
    for s in ("chat", "log", "card"):
        assert sum(r["repeats"] * r["tokens"] for r in rows if r["source"] == s) / total == pytest.approx(1 / 3, abs=0.02)
    assert any(r["assumed"] for r in rows)
    targets = spark.createDataFrame([(s, shares[s], caps[s]) for s in shares], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mix_report(mixed, targets).collect()}
    assert report["none"]["reached_share"] == 0 and report["chat"]["reached_share"] == pytest.approx(1 / 3, abs=0.02)
    assert sorted(map(tuple, mixer.mix(shares, caps).collect())) == sorted(map(tuple, rows))


def test_nothing_to_mix(spark, mixer):
    assert mixer.mix({"none": 1.0}, {"none": 2}).collect() == [] and mixer.mix({}, {}).collect() == []
    empty = Mixer(spark, spark.createDataFrame([], SCHEMA))
    assert empty.mix({"chat": 1.0}, {"chat": 1}).collect() == []
