"""Every registered query of the reference's operators: equal to its SQL, or a stable non-empty result."""

from __future__ import annotations

import pytest

from lodestone import plans

from .oracle import difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLE_SQL:
        assert difference(df, plans.ORACLE_SQL[name], SF) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries())
