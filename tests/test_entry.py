"""The entry points without the optional operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), sum(q.startswith('op') for q in e.queries()), 'pipeline' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"


@pytest.mark.parametrize("absent", [("serieswise/llm",), ("serieswise/llm", "corpus_pipeline.py"), ("serieswise/llm/queries.py",)])
def test_entry_loads_without_the_optional_operators(tmp_path, absent):
    shutil.copytree(os.path.join(ROOT, "serieswise"), tmp_path / "serieswise", ignore=shutil.ignore_patterns("__pycache__", *[os.path.basename(a) for a in absent]))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in absent and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, llm, pipeline, covered = done.stdout.split()
    assert int(n) > 100 and (llm, pipeline, covered) == ("0", "False", "True")
