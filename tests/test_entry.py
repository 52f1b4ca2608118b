"""The contract: every query runs, those with SQL agree with it, and the core stands without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest
from oracle import differences

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n in entry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert differences(spark, DATA, name, entry.queries()[name], entry.oracle_sql()[name]) == ""


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
def test_entry_has_a_stable_schema(spark):
    from pairforge.schema import CLIFF_COLUMNS

    assert entry.entry(spark).columns == CLIFF_COLUMNS


def test_core_without_the_optional_subpackage(tmp_path):
    code = "import sys; sys.modules['pairforge.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)


def test_nothing_else_imports_the_optional_subpackage():
    for p in (REPO / "pairforge").rglob("*.py"):
        if "llm" not in p.parts:
            assert "pairforge.llm" not in p.read_text(), p
