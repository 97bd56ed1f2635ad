import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

CODE = "import __spark_entry__ as e; print(sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("gone", [["probanda/llm", "corpus_pipeline.py"], ["probanda/llm"], ["corpus_pipeline.py"]])
def test_entry_without_the_corpus_operators(tmp_path, gone):
    """The entry module imports, and keeps all other queries, whichever of these are taken away."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda top, names: [n for n in names if n.startswith(".git") or n == "__pycache__" or os.path.relpath(f"{top}/{n}", ROOT) in gone])
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert "pair_and_gate" in done.stdout and "'pipeline'" not in done.stdout
    assert ("op5_" in done.stdout) == ("probanda/llm" not in gone and os.path.isdir(f"{ROOT}/probanda/llm"))
