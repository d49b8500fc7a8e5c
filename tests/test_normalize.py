import pytest
from pyspark.sql import functions as F

from spanforge.functions import normalize as nz
from tests.checks import connection  # noqa: F401

D = "b69a0d7e" * 8


def one(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]


def test_digests(spark):
    good = [D, D.upper(), f' "{D}"\n', f"\t{D}\n", f"{D}\n", "sha256:" + D, "SHA-256=" + D, "0x" + D.upper(), ":".join(D[i : i + 2] for i in range(0, 64, 2)), " ".join(D[i : i + 8] for i in range(0, 64, 8))]
    assert one(spark, nz.plain_digest, good) == [D] * len(good)
    bad = [None, "", "nan", "0" * 64, "sha256:" + "0" * 64, D[:-1], D + "0", D[:-1] + "g", "n/a"]
    assert one(spark, nz.plain_digest, bad) == [None] * len(bad)


def test_hashes(spark):
    assert one(spark, nz.hash_bits, ["ffffffffffffffff", "0x1", "1\n", "0", "nan", None, "8000000000000000", "12345678901234567"]) == [-1, 1, 1, None, None, None, -(2**63), None]


@pytest.mark.parametrize(("text", "wanted"), [("Train ", "train"), ("validation", "val"), ("External Eval", "external_eval"), ("external-eval", "external_eval"), ("testing", "test"), ("", None), (None, None), ("other", None)])
def test_splits(spark, text, wanted):
    assert one(spark, nz.plain_split, [text]) == [wanted]


def test_names(spark):
    assert one(spark, nz.plain_campaign, [" DS::C1 ", "ds / c1", "ds\\c1", "ds - c1", "ds|c1", "ds/c1", "n/a", "unknown", "", None]) == ["ds/c1"] * 6 + [None] * 4
    assert one(spark, nz.plain_name, ["Aerisgrid.", " aerisgrid", "AERISGRID/", "?", "unknown", None]) == ["aerisgrid"] * 3 + [None] * 3
    assert one(spark, nz.known_text, [" a b ", "N/A", "not  recorded", "-", " ", None, "null", "Skarn Q4"]) == ["a b", None, None, None, None, None, None, "Skarn Q4"]
    assert one(spark, nz.plain_label, ["FIELD_LOG", "field log ", "field-log", None, "-"]) == ["field_log"] * 3 + [None] * 2
    assert one(spark, lambda c: nz.path_part(c, 2), ["/mnt/pool/images/test/ds/c1/a.jpg", "images\\val\\ds\\c1\\b.png", "x.jpg", None]) == ["ds", "ds", None, None]
