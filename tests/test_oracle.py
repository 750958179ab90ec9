"""Every query runs on the smallest tables; those with SQL must agree with it."""

import importlib.util

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

CORE = [n for part in entry.PARTS if "llm" not in part.__name__ for n in part.QUERIES]


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, con, name):
    if name in entry.oracle_sql():
        assert compare(spark, small, name, con) == ""
    else:
        df = entry.queries()[name](spark, small)
        assert len(set(df.columns)) == len(df.columns)
        df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_text_package():
    from pathlib import Path

    root = Path(importlib.util.find_spec("schemaloom").origin).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "schemaloom.llm" not in path.read_text(), path
