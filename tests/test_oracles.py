import pytest

from tessera import catalog

from .oracle import check


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, folder, name):
    check(catalog.QUERIES[name](spark, folder), catalog.ORACLES[name], folder)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["corpus_profile", "class_tfidf_topics", "topic_trends", "rating_alpha"])
def test_partitions_do_not_matter(spark, folder, name, monkeypatch):
    from .oracle import rows

    first = catalog.QUERIES[name](spark, folder).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    second = catalog.QUERIES[name](spark, folder).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows(first, sorted(first.columns)) == rows(second, sorted(first.columns))
