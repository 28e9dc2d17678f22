"""Every registered query against the same question in SQL, and all of them for shape."""

from __future__ import annotations

import pytest

from quillmill.plans import catalog as Q

from .conftest import SMALL, rows_of


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_answers_as_sql_does(spark, duck, name):
    got = Q.QUERIES[name](spark, SMALL).toPandas()
    want = duck.sql(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_query_has_sql():
    assert set(Q.QUERIES) == set(Q.SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() >= 0


def test_entry_module_is_read_without_a_session():
    import subprocess
    import sys

    from .conftest import ROOT

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-500:]
