import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from halyard.plans import catalogue

ROOT = Path(__file__).parent.parent


def test_entry_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "rank", "key", "distance"] and df.count() == 125
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "halyard", tmp_path / "halyard", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES))] and len(catalogue.QUERIES) >= 65


def test_nothing_else_imports_them():
    for p in (ROOT / "halyard").rglob("*.py"):
        if "llm" not in p.parts:
            assert "halyard.llm" not in p.read_text()
