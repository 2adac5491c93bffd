"""The entry module without the parts that may be taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def listed(folder):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return [set(line.split()) for line in out.stdout.splitlines()]


@pytest.mark.parametrize("also", [["corpus_pipeline.py"], []])
def test_imports_without_the_training_data_package(tmp_path, also):
    from registered.oracle import ORACLE
    from registered.queries import QUERIES

    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *also))
    assert listed(copy) == [set(QUERIES), set(ORACLE)]


def test_other_import_errors_are_not_hidden(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    (copy / "shelfsift" / "llm").mkdir()
    (copy / "shelfsift" / "llm" / "__init__.py").write_text("")
    (copy / "shelfsift" / "llm" / "queries.py").write_text("import not_there_at_all")
    out = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "not_there_at_all" in out.stderr
