"""Every query of the core with SQL gives the SQL's rows."""

import pytest
from oracle import connection, same

from dyadic.plans import evidence, formats, graphs, lookups, problems

QUERIES = {k: (c.QUERIES[k], c.SQL[k]) for c in (problems, evidence, graphs, formats, lookups) for k in c.SQL}


@pytest.fixture(scope="module")
def con():
    return connection("sf0.001")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    same(spark, con, *QUERIES[name], "sf0.001")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_llm(spark, monkeypatch):
    """An llm folder that can't be imported, such as an empty one, takes only its own queries away."""
    import builtins

    import __spark_entry__

    real = builtins.__import__

    def gone(name, *args, **kwargs):
        if name.startswith("dyadic.llm"):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", gone)
    names = set(__spark_entry__.queries())
    assert "p5_found" in names and "read_mitab" in names and "p1_found" not in names
