"""The entry works where the training-data subpackage is not installed."""

import os
import subprocess
import sys

WITHOUT = """
import importlib.abc, sys

class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "voltlane.llm" or name.startswith("voltlane.llm."):
            raise ModuleNotFoundError(name, name=name)

import importlib.util
found = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name.startswith("voltlane.llm") else found(name, *a)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
queries, sql = entry.queries(), entry.oracle_sql()
assert not [q for q in queries if q.startswith("op") or q == "pipeline"]
assert set(sql) <= set(queries)
print(len(queries))
"""


def test_entry_without_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", WITHOUT], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 146
