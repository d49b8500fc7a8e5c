import pytest

from spanforge.llm import queries
from tests.checks import same

COLUMNS = {"p1_found": ["sha256", "group_sha256"], "p2_found": ["manifest_index", "match_kind"], "p3_found": ["rid", "group_source"], "p5_found": ["overlay_id_a", "overlay_id_b"], "p6_found": ["sha256", "field_name", "manifest_index"], "p7_found": ["doc_id"], "p9_found": ["doc_id", "subject"]}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    same(spark, sf_dir, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns == COLUMNS[name] and df.count() == df.distinct().count()
