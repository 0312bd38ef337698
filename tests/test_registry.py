"""Every registered query against its SQL in another engine."""

import os

import pytest

import __spark_entry__ as entry
from casewatch.plans.registry import QUERIES
from tools import check

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(QUERIES)


@pytest.fixture(scope="module")
def db():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, db, name):
    verdict, _, _ = check.compare(spark, db, SF_DIR, name)
    assert verdict in ("equal", "rows only")


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry.oracle_sql())


def test_entry_is_lazy_and_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "n"]
    assert df.count() > 0
