"""The driver contract holds without the optional text operators."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in ("flowloom.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
assert len(entry.queries()) >= 260 and set(entry.oracle_sql()) <= set(entry.queries())
assert not any(name.startswith("op") or name == "pipeline" for name in entry.queries())
"""


def test_entry_works_without_text_operators():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=REPO, check=True, timeout=120)
