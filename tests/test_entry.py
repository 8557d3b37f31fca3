"""The entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "fixturelake", tmp_path / "fixturelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'bridge_pattern' in q and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    for leftover in (False, True):
        if leftover:
            (tmp_path / "fixturelake/llm/__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_flagship(spark):
    import __spark_entry__ as entry

    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
