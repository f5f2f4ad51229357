"""Every core query against its SQL at the smallest scale; queries without SQL must run and give rows."""

import pytest

from clauseloom.plans import registry
from conftest import same_rows

NO_ROWS_AT_THIS_SCALE = {"correction_signal"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    same_rows(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0 or name in NO_ROWS_AT_THIS_SCALE


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_llm():
    import pathlib

    root = pathlib.Path(registry.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "clauseloom.llm" not in path.read_text(), path
