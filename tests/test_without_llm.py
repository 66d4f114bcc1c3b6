"""The library imports and registers its queries without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tallyspark.llm") or name == "corpus_pipeline":
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "c01_gap" in e.queries() and not any(k.startswith("op") or k == "pipeline" for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_point_without_the_optional_subpackage():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True)


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "tallyspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "tallyspark.llm" not in path.read_text() and "from .llm" not in path.read_text()
