"""The library stands without the training-data subpackage."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in ROOT.glob("tidewheel/**/*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.MULTILINE), path


def test_the_entry_imports_without_it(tmp_path):
    def left_out(folder, names):
        return [n for n in names if n in ("llm", ".git", "corpus_pipeline.py", "__pycache__")]

    shutil.copytree(ROOT, tmp_path / "repo", ignore=left_out)
    code = "import __spark_entry__ as e; q = set(e.queries()); assert 'sessions_15m' in q and not any(x.startswith('op') for x in q) and q == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120)
