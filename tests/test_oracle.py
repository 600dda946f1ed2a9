"""Every query against its SQL, over whole tables. ``ORACLE_SF`` picks the scale."""

import os

import oracle
import pytest

from corpusmill.catalog import ORACLE, QUERIES

FOLDER = f"/root/testdata/sf{os.environ.get('ORACLE_SF', '0.001')}"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    assert oracle.difference(QUERIES[name](spark, FOLDER), duck, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(df.collect()) > 0 and df.columns


def test_every_statement_belongs_to_a_query():
    assert set(ORACLE) <= set(QUERIES)
