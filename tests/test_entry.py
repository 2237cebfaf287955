import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_imports_the_training_data_package(tmp_path):
    """The rest works where the subpackage and its pipeline are gone."""
    import shutil

    shutil.copytree(ROOT / "causalpanel", tmp_path / "causalpanel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'monthly_rank_ic' in q and not [n for n in q if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__ as e

    d = e.entry(spark)
    assert d.columns == ["month", "ic", "n"] and d.count() > 0
