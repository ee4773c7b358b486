import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def stripped(tmp_path_factory):
    """A copy without the training-data operators, their tests and the pipeline."""
    to = tmp_path_factory.mktemp("stripped")
    shutil.copytree(ROOT / "sluice", to / "sluice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(ROOT / "tests", to / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, to)
    return to


def run_in(folder, *args):
    return subprocess.run([sys.executable, *args], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True)


def test_core_stands_without_the_training_data_operators(stripped):
    code = "import __spark_entry__ as e; q = e.queries(); assert 'join_inner' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql(); import bench"
    done = run_in(stripped, "-c", code)
    assert done.returncode == 0, done.stderr


def test_core_tests_pass_without_the_training_data_operators(stripped):
    """All of the core's tests can be collected there, and those that take little time pass."""
    done = run_in(stripped, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert done.returncode == 0, done.stdout
    done = run_in(stripped, "-m", "pytest", "tests/test_functions.py", "tests/test_session.py", "tests/test_entry.py", "-q", "-p", "no:cacheprovider", "-k", "not training_data and not broken")
    assert done.returncode == 0, done.stdout


def test_a_broken_operator_is_not_taken_for_an_absent_one(stripped):
    (stripped / "sluice" / "llm").mkdir()
    (stripped / "sluice" / "llm" / "__init__.py").write_text("")
    (stripped / "sluice" / "llm" / "registry.py").write_text("import nowhere_to_be_found\n")
    try:
        done = run_in(stripped, "-c", "import __spark_entry__ as e; e.queries()")
    finally:
        shutil.rmtree(stripped / "sluice" / "llm")
    assert done.returncode != 0 and "nowhere_to_be_found" in done.stderr
