"""Every registered query gives the rows of its SQL."""

import os

import pytest
from oracle import DATA, same

from corvane.plans import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLES:
        same(spark, queries.QUERIES[name], queries.ORACLES[name])
    else:
        assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry_is_registered():
    import __spark_entry__

    assert "hybrid_rrf_filtered" in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    spark.read.parquet(f"{DATA}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.streamed(spark, str(tmp_path)).points.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
