"""The entry file without the subpackage of the training-data operations, with and without the pipeline's file."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(sorted(q))"


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",)])
def test_queries_without_the_subpackage(tmp_path, gone):
    shutil.copytree(ROOT / "galerna", tmp_path / "galerna", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert "rolling_24h_72h" in out.stdout and "op1_bpe" not in out.stdout and "pipeline" not in out.stdout


def test_queries_without_a_library_that_the_subpackage_needs(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    shutil.copytree(ROOT / "galerna", tmp_path / "galerna", ignore=shutil.ignore_patterns("__pycache__"))
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('absent')\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert "rolling_24h_72h" in out.stdout and "op1_bpe" not in out.stdout and "pipeline" not in out.stdout
