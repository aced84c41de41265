import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import compare, connect  # noqa: E402

from millrace.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline

    assert 0 < corpus_pipeline.run(spark, SF).count()
