"""Every query against its SQL on the smallest tables."""

import pytest

from quillon.plans import ORACLE, QUERIES
from tests.util import oracle, rows


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    df = QUERIES[name](spark, data)
    names, expected = oracle(ORACLE[name], data)
    assert sorted(df.columns) == names
    assert rows(df) == expected


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "total", "score", "fields"]
    assert set(QUERIES) <= set(e.queries())


@pytest.mark.parametrize("name", ["q_cluster_summary", "q_cluster_review"])
def test_clusters_beyond_three_digits(spark, tmp_path, name):
    """Over 999 clusters, and documents without text or language: the ids and groups of the SQL."""
    text = "case id % 1100 when 0 then '' when 1 then null when 2 then '\n' else 'text ' || id % 1100 end"
    docs = spark.range(2200).selectExpr("id as doc_id", f"{text} as text", "case when id % 9 = 0 then null when id % 1100 = 2 then '' else 'en' end as lang", "'src' || id % 5 as source")
    docs.coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert rows(QUERIES[name](spark, str(tmp_path))) == oracle(ORACLE[name], str(tmp_path))[1]
