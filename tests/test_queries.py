"""Every registered query of the core against its SQL on the small tables."""

from __future__ import annotations

import pytest
from compare import SF, differences, oracle

from siftlake.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle(SF.replace("sf0.01", "sf0.001"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sf = SF.replace("sf0.01", "sf0.001")
    if name in ORACLE_SQL:
        assert differences(spark, con, name, QUERIES[name], ORACLE_SQL[name], sf) == []
    else:
        assert QUERIES[name](spark, sf).count() > 0
