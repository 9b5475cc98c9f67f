"""Every query of the core operators against its SQL on another engine."""

import pytest

import __spark_entry__ as entry
from eventloom.plans.queries import QUERIES

from helpers import database, same_as_sql


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(entry.oracle_sql())))
def test_query_matches_sql(spark, small, con, name):
    same_as_sql(QUERIES[name](spark, small), con, entry.oracle_sql()[name])


def test_entry_has_the_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_core_query_but_folds_has_sql():
    assert set(QUERIES) - set(entry.oracle_sql()) == {"balanced_assignment"}


def test_entry_works_without_the_optional_parts(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "tests"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) == len(QUERIES)
