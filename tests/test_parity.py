"""Every query against its SQL oracle on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry
from parity import connect, difference

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, oracle, name):
    assert difference(spark, oracle, entry.queries()[name], entry.oracle_sql()[name], SF_DIR) is None


def test_every_query_has_an_oracle():
    """All but those of the training-data part, which has tests of its own."""
    others = {n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d+_", n)}
    assert others <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["skill", "count"]
