"""The entry works where the training-data package is not installed."""

import os
import subprocess
import sys

HIDDEN = """
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("quotalens.llm"):
            raise ModuleNotFoundError(name)

    def invalidate_caches(self):
        pass

import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name.startswith("quotalens.llm") else real(name, package)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 200 and not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert set(entry.oracle_sql()) <= set(names)
"""


def test_import_without_the_package():
    root = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
    subprocess.run([sys.executable, "-c", HIDDEN], cwd=root, check=True, timeout=120)
