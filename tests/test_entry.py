"""The driver's contract, and that the core does without the subpackage for training data."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert all(callable(f) for f in e.queries().values())


def test_core_without_llm():
    code = "import sys; sys.modules['logothek.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in (ROOT / "logothek").rglob("*.py"):
        if "llm" not in p.parts:
            assert "logothek.llm" not in p.read_text(), p


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
