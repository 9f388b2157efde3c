"""The driver contract: every oracle text belongs to a registered query, and
the flagship query runs."""

import __spark_entry__ as E


def test_contract_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"a", "b", "n_common", "height_a", "height_b", "similarity", "distance"}
