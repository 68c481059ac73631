"""The entry module where the training-data part, or a library that it needs, is absent."""

import subprocess
import sys
from pathlib import Path

import pytest

from lectern.plans.catalog import QUERIES

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("absent", ["zstandard", "lectern.llm", "corpus_pipeline"])
def test_other_queries_stay(absent):
    code = f"import sys; sys.modules[{absent!r}] = None; import __spark_entry__ as e; print(len(e.queries()), any(q.startswith('op') for q in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(QUERIES)), "False"], done.stderr
    assert "left out" in done.stderr
