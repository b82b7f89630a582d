"""The optional corpus operators may be absent: the registry and all else must still work."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 80 and "rfm_customers" in names
assert not any(name.startswith("op") and name[2].isdigit() or name == "pipeline" for name in names)
assert set(entry.oracle_sql()) <= set(names)
import bench, checks.compare
"""


def test_registry_without_the_optional_part(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "spark-warehouse", "__pycache__", ".pytest_cache"))
    for with_pipeline in (True, False):
        if not with_pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
