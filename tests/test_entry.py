"""The driver's functions with and without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_the_corpus_folders(tmp_path, pipeline):
    for name in ("gridsquall", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source) and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert len(q) > 140 and set(s) <= set(q); assert not [k for k in q if k.startswith('op') or k == 'pipeline']"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
