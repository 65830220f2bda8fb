"""The entry works with and without the corpus half."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; print(len(e.queries()), sorted(set(e.oracle_sql()) - set(e.queries())), [n for n in e.queries() if n.startswith('op') and n[2].isdigit() or n == 'pipeline'])"


def listed(folder):
    done = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_entry_without_the_corpus_half(tmp_path):
    shutil.copytree(os.path.join(ROOT, "quarry"), tmp_path / "quarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    assert listed(tmp_path).rstrip().endswith("[] []")
    if os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):  # the file alone, without its subpackage
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
        assert listed(tmp_path).rstrip().endswith("[] []")
