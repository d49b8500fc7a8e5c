import json
import zipfile

import pytest

from spanforge.sources import readers as r


def test_csv(spark, tmp_path):
    p = str(tmp_path / "a.csv")
    with open(p, "w") as f:
        f.write('k,v\n1,\n2,"x, ""y"""\n,NaN\n')
    assert [tuple(x) for x in r.read_csv(spark, p, ["k", "v"]).collect()] == [("1", ""), ("2", 'x, "y"'), ("", "NaN")]
    assert r.read_csv(spark, str(tmp_path / "none.csv"), ["k"]).collect() == []
    df = spark.createDataFrame([("a", ""), ("b", 'q"')], "k string, v string")
    r.write_csv(df, str(tmp_path / "out"), compressed=True)
    assert sorted(map(tuple, r.read_csv(spark, str(tmp_path / "out"), ["k", "v"]).collect())) == [("a", ""), ("b", 'q"')]
    assert r.stripped(spark.createDataFrame([(1,)], "`  x ` int")).columns == ["x"]


def test_json_lines(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    with open(p, "w") as f:
        f.write('{"k":1,"v":"a"}\n\n{"k":1,"v":"b"}\n{"k":2,"v"')
    rows = r.read_json_lines(spark, p, "k int, v string")
    assert [tuple(x)[1:] for x in rows.orderBy("line").collect()] == [(0, 1, "a"), (2, 1, "b")]
    assert r.last_per_key(rows, "k", ["file", "line"]).select("k", "v").collect()[0]["v"] == "b"
    with open(p, "w") as f:
        f.write('{"k":1\n{"k":2,"v":"b"}\n')
    with pytest.raises(Exception, match="broken line"):
        r.read_json_lines(spark, p, "k int, v string").collect()
    assert r.read_json_lines(spark, str(tmp_path / "no.jsonl"), "k int").collect() == []


def test_upsert_and_resume(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, r.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c")]
    assert [x["k"] for x in r.not_done(old, new, "k").collect()] == [1]


def test_labels(spark):
    text = "3.0 .5 .5 .2 .2 .9\n\nbad .5 .5 .2 .2\n1 .5\n3.7 .1 .1 .2 nan\n3.7 .1 .1 .2 .3\r\n"
    df = spark.createDataFrame([("i", text), ("j", None)], "image string, text string")
    rows = r.parse_labels(df).orderBy("idx").collect()
    assert [(x["image"], x["idx"], x["cls"], x["h"]) for x in rows] == [("i", 0, 3, 0.2), ("i", 1, 3, 0.3)]
    bad = spark.createDataFrame([("i", "0 .5 .5 .2 .2\n0 .5 .5 .2\n9 .5 .5 .2 .2\n1 2 .5 .2 .2\n1 .5 .5 0 .2\n1 x .5 .2 .2\n1 inf .5 .2 .2")], "image string, text string")
    assert sorted((x["line"], x["problem"]) for x in r.label_problems(bad).collect()) == [(1, "field_count"), (2, "class_id"), (3, "out_of_range"), (4, "no_extent"), (5, "not_numeric"), (6, "not_finite")]
    boxes = spark.createDataFrame([("i", 0, 1, 0.5, 0.5, 0.25, 0.25), ("i", 1, 4, 0.5, 0.5, 0.0, 0.2)], "image string, idx int, cls int, cx double, cy double, w double, h double")
    assert r.format_labels(boxes, "image").first()["text"] == "1 0.50000000 0.50000000 0.25000000 0.25000000\n"


def test_voc_and_coco(spark, tmp_path):
    p = str(tmp_path / "a.xml")
    with open(p, "w") as f:
        f.write("<annotation><filename>a.jpg</filename><size><width>200</width><height>100</height></size><object><name>Nest</name><bndbox><xmin>-10</xmin><ymin>10</ymin><xmax>250</xmax><ymax>60</ymax></bndbox></object></annotation>")
    row = r.read_voc(spark, p, {"nest": 3}).first()
    assert (row["cls"], row["cx"], row["cy"], row["w"], row["h"]) == (3, 0.5, 0.35, 1.0, 0.5)
    boxes = spark.createDataFrame([(7, 0, 1, 0.5, 0.5, 0.2, 0.4)], "image long, idx int, cls int, cx double, cy double, w double, h double")
    parts = r.to_coco(boxes, spark.createDataFrame([(7, 100, 50)], "image long, width int, height int"), ["a", "b"]).collect()
    doc = {k: [json.loads(x["value"]) for x in parts if x["part"] == k] for k in ("images", "annotations", "categories")}
    with open(str(tmp_path / "c.json"), "w") as f:
        json.dump(doc, f)
    row = r.read_coco(spark, str(tmp_path / "c.json")).first()
    assert (row["category"], row["file_name"]) == ("b", "7.jpg") and [round(row[c], 9) for c in ("cx", "cy", "w", "h")] == [0.5, 0.5, 0.2, 0.4]


def test_nested(spark):
    doc = json.dumps([{"output": {"predictions": [{"x": 50, "y": 40, "width": 60, "height": 20, "class": "nest", "confidence": "0.5", "class_id": "q"}]}}])
    df = spark.createDataFrame([(1, doc), (2, "{"), (3, None)], "k int, j string")
    assert [tuple(x) for x in r.nested_boxes(df, "k", "j").collect()] == [(1, 0, 20.0, 30.0, 80.0, 50.0, "nest", -1, 0.5)]
    arrays = spark.createDataFrame([("i", [1], [0.5], [[0.1, 0.2, 0.3, 0.4]])], "image string, cls array<int>, conf array<double>, xywhn array<array<double>>")
    assert tuple(r.predictions(arrays).first()) == ("i", 0, 1, 0.5, 0.1, 0.2, 0.3, 0.4)


def test_archives(spark, tmp_path):
    items = [("d/b.txt", b"2"), ("d/a.txt", b"1"), ("e/d/a.txt", b"3")]
    for name in ("x.tar.gz", "x.zip"):
        first, second = str(tmp_path / ("1" + name)), str(tmp_path / ("2" + name))
        r.write_archive(items, first)
        r.write_archive(items[::-1], second)
        assert open(first, "rb").read() == open(second, "rb").read()
        got = {x["suffix"]: (bytes(x["content"]), x["copies"]) for x in r.archive_members(spark, first).collect()}
        assert got == {"d/a.txt": (b"1", 2), "d/b.txt": (b"2", 1)}
    assert zipfile.is_zipfile(str(tmp_path / "1x.zip"))
