"""Every query of the core against its SQL, which is written on its own."""

import importlib

import pytest

from conftest import check_against_sql

MODULES = ["references", "catalog", "readings", "motifs", "similarity", "quality", "star", "features", "fragments", "records"]
PAIRS = [(name, m) for m in MODULES for name in importlib.import_module(f"tellstone.plans.{m}").QUERIES]


@pytest.mark.parametrize("name,module", PAIRS, ids=[p[0] for p in PAIRS])
def test_query(spark, folder, duck, name, module):
    m = importlib.import_module(f"tellstone.plans.{module}")
    if name in m.SQL:
        check_against_sql(spark, folder, duck, m.QUERIES[name], m.SQL[name])
    else:
        m.QUERIES[name](spark, folder).count()


def test_entry(spark, folder):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
