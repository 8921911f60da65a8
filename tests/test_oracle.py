"""Every query that has SQL, at the smallest scale factor, beside that SQL in DuckDB."""

import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from lynxmark.plans.catalog import ORACLE_SQL, QUERIES
from tests.oracle import difference


#: Queries that find nothing in the smallest tables, though they do at sf0.01.
MAY_BE_EMPTY = {"flt_snapshot_lookup", "srt_product_page"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    said = difference(spark, sf, QUERIES[name], ORACLE_SQL[name])
    assert said == ("no rows" if name in MAY_BE_EMPTY else ""), said


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("missing", ["lynxmark.llm", "sentencepiece", "corpus_pipeline"])
def test_what_cannot_be_imported_is_left_out(missing):
    """In a process of its own: neither the corpus folder nor what it needs is asked for by any other query."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len([k for k in q if k[:2] != 'op' and k != 'pipeline']), 'pipeline' in q, set(s) <= set(q))"
    told = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, check=True).stdout.split()
    assert told == [str(len(QUERIES)), "False", "True"]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
