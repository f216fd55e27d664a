"""The entry module with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("weftline.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
assert e.queries() and not any(q.startswith("op") or q == "pipeline" for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_imports_without_the_optional_subpackage():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_flagship(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["src", "dst", "points", "rank", "is_known"] and df.limit(1).count() == 1
