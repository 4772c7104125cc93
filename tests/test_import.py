"""The driver's entry has to import before there is a session, with and without the corpus operators."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("block", ["", "import sys; sys.modules['cladeworks.llm'] = None; sys.modules['corpus_pipeline'] = None; "])
def test_entry_imports_without_a_session(block):
    code = block + "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(s) <= set(q); print(len([k for k in q if k.startswith('op')]))"
    env = {**os.environ, "PYTHONPATH": str(ROOT)}
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) in ((0,) if block else (0, 10))
