"""Every SQL-expressible registered query equals its DuckDB oracle exactly."""

import os

import pytest

from tests.oracle_compare import compare

SF = os.environ.get("STORELENS_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_all_oracles_match(spark):
    res = compare(spark, SF, verbose=False)
    bad = {k: v for k, v in res.items() if v != "OK"}
    assert len(res) >= 55
    assert not bad, bad
