"""The repository without its corpus operators."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def names_in(folder: Path) -> subprocess.CompletedProcess:
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.pathsep.join([str(folder), os.environ.get("PYTHONPATH", "")])})


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_corpus_operators(tmp_path, pipeline):
    """Both folders gone, and the pipeline or not: the rest imports and has the same queries."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
    found, sql = json.loads(names_in(tmp_path / "copy").stdout)
    assert not [n for n in found if n.startswith("op") and n[2].isdigit()] and "pipeline" not in found
    assert len(found) > 60 and set(sql) <= set(found)


def test_import_errors_are_not_swallowed(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (tmp_path / "copy/corpus_pipeline.py").write_text("import a_module_that_nobody_has\n")
    assert "a_module_that_nobody_has" in names_in(tmp_path / "copy").stderr
