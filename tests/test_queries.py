"""Every registered query against its SQL on the same tables."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from ledgerloom.plans import load
from tools.compare import compare, database

NAMES = sorted(load())


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf_dir, name):
    ok, note = compare(spark, con, sf_dir, name)
    assert ok, note
    assert "types" not in note, note


def test_every_query_of_the_library_has_sql():
    assert {n for n, q in load().items() if not q.sql} == set()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vintage_year", "total_invested", "nav", "years_held", "moic", "irr", "matched_rows"]
    assert df.count() > 0


def test_entry_survives_a_missing_module_of_the_optional_subpackage():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op')]; assert len(e.oracle_sql()) > 150"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(entry.__file__).parent, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
