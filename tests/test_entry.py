"""The entry module with and without the subpackage for training data."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120, check=True)
    return [set(line.split()) for line in done.stdout.splitlines()]


def test_imports_without_the_subpackage(tmp_path):
    bare = tmp_path / "bare"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    queries, sql = names(bare)
    assert queries and sql <= queries and not any(q.startswith("op") or q == "pipeline" for q in queries)
    os.remove(bare / "corpus_pipeline.py")
    assert names(bare) == [queries, sql]
