"""Every registered query agrees with its SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as driver
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    return check.connect(SF)


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_agrees_with_sql(spark, con, name):
    text, ok = check.compare(spark, con, name, SF)
    assert ok, text


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
