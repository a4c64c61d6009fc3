import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 11
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_does_not_need_the_training_data_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("kinetrail.llm", "corpus_pipeline")):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "msd" in e.queries() and "pipeline" not in e.queries() and not any(x.startswith("op") for x in e.queries() if x[2:3].isdigit())
e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
