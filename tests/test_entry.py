"""The driver's contract, with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).resolve().parent


def test_every_sql_has_its_query(spark):
    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 100
    assert entry.entry(spark).count() == 5


def names_in(folder):
    """The queries that a copy of the repository registers, in a process of its own."""
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*sorted(e.queries()), sep='\\n'); assert set(e.oracle_sql()) <= set(e.queries())"], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    return done.returncode, done.stdout.split(), done.stderr


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT / "lakewarden", tmp_path / "lakewarden", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def test_entry_works_without_training_data(copy):
    code, names, error = names_in(copy)
    assert code == 0, error
    assert len(names) > 100 and "pipeline" not in names and not any(n.startswith("op") for n in names)


def test_broken_training_data_is_an_error(copy):
    (copy / "lakewarden" / "llm").mkdir()
    (copy / "lakewarden" / "llm" / "__init__.py").write_text("")
    (copy / "lakewarden" / "llm" / "queries.py").write_text("import no_such_module\n")
    (copy / "corpus_pipeline.py").write_text("")
    code, _, error = names_in(copy)
    assert code != 0 and "no_such_module" in error
