"""The rest of the repository without the text operators: a copy of the tree without them imports and runs."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import __spark_entry__ as e
assert "op1" not in "".join(e.queries()) and "pipeline" not in e.queries() and len(e.queries()) > 90
assert set(e.oracle_sql()) <= set(e.queries())
import bench
"""


def test_without_the_text_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache"))
    shutil.rmtree(copy / "terralith" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    for pipeline in (True, False):  # the pipeline's file may stay behind
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr


MISSING = """
import sys
sys.modules["public_tokenizers"] = None  # a library that only the text operators need
import __spark_entry__ as e
assert "pipeline" not in e.queries() and len(e.queries()) > 90
"""


def test_without_a_library_of_the_text_operators():
    done = subprocess.run([sys.executable, "-c", MISSING], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
