"""The entry points do without the training-data subpackage and the libraries it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).parent.parent)
SCRIPT = """
import sys
sys.modules[{name!r}] = None  # an import of it raises ImportError
import __spark_entry__ as entry
names = set(entry.queries())
assert not any(n.startswith("op1_") for n in names) and "log_sql" in names and len(names) >= 70
assert set(entry.oracle_sql()) <= names
"""


@pytest.mark.parametrize("name", ["fleetledger.llm", "fleetledger.llm.queries", "sentencepiece", "xxhash"])
def test_other_queries_stay_where_an_import_fails(name):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(name=name)], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]
