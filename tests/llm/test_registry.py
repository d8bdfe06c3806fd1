import pytest
from oracle import SF, compare

from quillstone.llm import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_every_document_is_answered(spark, name):
    rows = registry.queries()[name](spark, SF).select("doc_id").distinct().count()
    assert rows == spark.read.parquet(f"{SF}/documents.parquet").count()
