"""Every registered query of the engine's own operators against its SQL."""

import pytest

from oracle_helpers import DATA, rows_of, rows_of_sql
from qvault.plans.all_queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, DATA)) == rows_of_sql(duck, ORACLES[name])


def test_absent_modules_leave_the_other_queries(monkeypatch):
    """Without the training-data folders, or a module that they need, all other queries are there."""
    import __spark_entry__

    def refuse(name):
        raise ImportError(name)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", refuse)
    with pytest.warns(UserWarning):
        assert set(__spark_entry__.queries()) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
