"""The training-data queries against their SQL, brute force and fixed cases."""

import pytest

from strataclaim.llm import queries as training
from tests.oracle import connect, same

QUERIES, SQL = training.queries(), training.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, small, name):
    """Tables of no rows give results of no rows."""
    for t in ("chunks", "observations", "causal_relations", "beliefs", "training_examples", "private_papers", "documents"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for t in ("concept_cells", "eval_items"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
