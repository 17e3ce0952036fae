"""The entry with and without the text operators."""

from __future__ import annotations

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import json, __spark_entry__ as e; print(json.dumps([e.TEXT, sorted(e.queries()), sorted(e.oracle_sql())]))"


def listed(folder) -> tuple[bool, set[str], set[str]]:
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONDONTWRITEBYTECODE": "1"})
    text, queries, oracles = json.loads(done.stdout.splitlines()[-1])
    return text, set(queries), set(oracles)


@pytest.mark.parametrize("left_over", [False, True])
def test_entry_without_the_text_operators(tmp_path, left_over):
    shutil.copytree(ROOT / "gradelake", tmp_path / "gradelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left_over:  # an empty folder counts as a package for Python
        (tmp_path / "gradelake" / "llm").mkdir()
        (tmp_path / "corpus_pipeline.py").write_text("raise ImportError('must not be loaded')")
    text, queries, oracles = listed(tmp_path)
    assert not text and len(queries) > 240 and oracles <= queries and not any(q.startswith("op") or q == "pipeline" for q in queries)


def test_entry_lists_oracles_of_its_own_queries():
    text, queries, oracles = listed(ROOT)
    assert oracles <= queries and text == (ROOT / "corpus_pipeline.py").exists()
