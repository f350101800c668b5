"""The entry module without the training-data operators, or with what is left of them."""

import os
import shutil
import subprocess
import sys

import pytest

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"


def copied(place, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *without)
    shutil.copytree(TOP, place, ignore=skip, dirs_exist_ok=True)
    return subprocess.run([sys.executable, "-c", COUNT], cwd=place, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(place)})


@pytest.mark.parametrize("left", ["nothing", "cache", "pipeline"])
def test_without_the_subpackage(tmp_path, left):
    if left == "cache":
        os.makedirs(tmp_path / "pareframe/llm/__pycache__")
    found = copied(tmp_path, "llm", *(() if left == "pipeline" else ("corpus_pipeline.py",)))
    assert found.returncode == 0, found.stderr
    n, sql, any_op = found.stdout.split()[-3:]
    assert int(n) >= int(sql) > 50 and any_op == "False"


def test_with_a_library_missing(tmp_path):
    (tmp_path / "ahocorasick.py").write_text("raise ImportError\n")
    found = copied(tmp_path)
    assert found.returncode == 0 and found.stdout.split()[-1] == "False", found.stderr
