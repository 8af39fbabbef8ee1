"""The operators that SQL can express against DuckDB, on the smallest tables and on awkward rows."""

import pytest

from inkfold.llm import queries

from ..test_oracle import compare
from .common import DIR, HAVE, edge_docs


@pytest.mark.skipif(not HAVE, reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    compare(queries.QUERIES[name](spark, DIR), queries.ORACLE_SQL[name], DIR)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL.keys() - {"op1_best_fit_packing"}))  # its SQL takes ids as unique
def test_awkward_rows(spark, name, tmp_path):
    docs = edge_docs(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    compare(queries.QUERIES[name](spark, str(tmp_path)), queries.ORACLE_SQL[name], str(tmp_path))
