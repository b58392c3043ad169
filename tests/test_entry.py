import __spark_entry__ as E

from seqpool.plans import catalog, oracle


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"seq_id", "slice", "value"}


def test_every_query_has_its_sql():
    assert set(catalog.REGISTRY) <= set(E.queries())
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.REGISTRY) - set(oracle.SQL) <= catalog.WITHOUT_SQL
