import random

from spanforge.llm import subjects as s

TOPICS = {"birds": (["kestrel", "stork nest", "raven chick", "heron"], ["flew off early", "feeds three chicks"]), "law": (["tenancy contract", "easement deed", "licence notice"], ["was contested in court", "expires this quarter"]), "sport": (["goalkeeper", "chess evening", "relay team"], ["won the cup final", "trains twice weekly"])}
FILLER = ["nothing else to add", "see page {} of the folder", "more will follow next week", "the entry was typed up later"]


def paragraph(topic, aside=None):
    if topic is None:
        return ". ".join(random.choice(FILLER).format(random.randrange(999)) for _ in range(4))
    nouns, verbs = TOPICS[topic]
    text = ". ".join(random.choice([f"the {random.choice(nouns)} {random.choice(verbs)}", random.choice(FILLER)]) for _ in range(7)) + f". the {nouns[0]} {verbs[0]}. the {nouns[1]} {verbs[1]}"
    return text + (f" (a note about the {random.choice(TOPICS[aside][0])})" if aside else "")


def corpus(n=500, seed=4):
    random.seed(seed)
    rows, truth = [], {}
    for i in range(n):
        chosen = random.sample([*TOPICS, None], random.randrange(1, 4))
        truth[i] = {t for t in chosen if t}
        rows.append((i, "\n\n".join(paragraph(t, random.choice([None, *[x for x in TOPICS if x != t]])) for t in chosen)))
    return rows, truth


def test_text_forms():
    assert s.paragraphs("A<br><br>\nB\r\n\r\nC") == ["a", "b", "c"]
    assert s.paragraphs("Trá»\x8dng sá»\x91") == ["trong so"] and s.paragraphs("Straße đường") == ["strasse duong"]
    items = lambda *parts: s.paragraph_items(list(parts), s._Codes())
    same = lambda a, b: items(a)[0].tolist() == items(b)[0].tolist()
    assert same("birhc 12", "birch") and same("birch", "bireh") and same("b1rch f0rm", "blrch form") and not same("birch form", "form birch")
    assert items("(a note about the raven)")[0].tolist() == [] and s.paragraphs("  \n\n ") == []
    assert items("a fox", "", "a fox a fox. fox", "fox. a")[1].tolist() == [0, 2, 2, 5, 6] and items()[1].tolist() == [0]


def test_learned_subjects(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame([(i, t, "?", 0) for i, t in rows] + [(9000, None, "?", 0), (9001, "", "?", 0), (9002, "goal " * 20_000, "?", 0)], "doc_id long, text string, items string, para int")
    marks = [(i, t.upper() + " " if i % 3 else t) for i in range(0, 500, 5) for t in truth[i]]
    wrong = [(0, "unheard"), (7777, "law"), (None, "law"), (3, None)] + marks[:5]
    labels = spark.createDataFrame(marks + wrong, "doc_id long, subject string")
    out = s.paragraph_subjects(spark, docs, labels, sorted(TOPICS))
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    pairs, wanted = {(d, x) for d, xs in got.items() for x in xs if d < 9000}, {(d, x) for d, xs in truth.items() for x in xs}
    assert len(pairs & wanted) / len(pairs) > 0.97 and len(pairs & wanted) / len(wanted) > 0.97
    assert not {9000, 9001} & set(got)
    assert s.paragraph_subjects(spark, docs, labels.limit(0), sorted(TOPICS)).collect() == []
    assert s.paragraph_subjects(spark, docs.limit(0), labels, sorted(TOPICS)).collect() == []


def test_grown_rules(spark):
    # no word and no two tell the class, all three together do; and two others
    together = [[1, 2, 3]] * 40 + [[1, 2]] * 25 + [[1, 3]] * 25 + [[2, 3]] * 25 + [[1]] * 12 + [[2]] * 12 + [[3]] * 12
    rows = [(x, [0] if len(x) == 3 else [1]) for x in together] + [([4, 5], [0])] * 30 + [([4], [1])] * 30 + [([5], [1])] * 30 + [([0], [1])] * 400
    df = spark.createDataFrame(rows, "items array<int>, classes array<int>")
    rules = s.mine_rules(df, 2, 6, 0.001, confidence=0.9, hint=0.2, gain=0.02)
    assert rules.grown.tolist() == [False, True, True, True, True, True] and len(rules.levels) == 2
    two, three = rules.levels
    assert two.codes[two.kind == 0].tolist() == [4 * 6 + 5] and three.kind.tolist() == [0]
    assert rules.listed() >= {(1, 2, 3, 0), (4, 5, 0)} and rules.changed(rules) == 0 < rules.changed(s.Rules(2, 6, rules.item_class, rules.item_weight, rules.grown))
    items = s.pa.array([[1, 2, 3], [1, 3], [4, 5], [], [1, 2, 3, 4, 5]], s.pa.list_(s.pa.int32()))
    assert rules.evidence(*s._flat(items), 5)[1][:, 0].tolist() == [1, 0, 1, 0, 2]
    # rules that are rare everywhere aren't rules
    assert not s.mine_rules(df, 2, 6, 0.5, confidence=0.9, hint=0.2).levels
