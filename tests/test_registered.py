from __future__ import annotations

import pytest
from oracle import agree

import __spark_entry__ as entry
from plyweave.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_agrees_with_sql(spark, name):
    agree(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_differences_are_registered(spark):
    sf_dir = "/root/testdata/sf0.01"
    changed = registry.queries()["reconcile"](spark, sf_dir).filter("status = 'changed'").count()
    assert registry.queries()["row_diff_all"](spark, sf_dir).count() == changed > 100
