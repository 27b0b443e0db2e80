"""The driver's entry on a copy of the repository without the folders that may be removed."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; print(*e.queries(), sep='\\n'); print('--'); print(*e.oracle_sql(), sep='\\n')"


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_queries_without_the_subpackage(tmp_path, also):
    copy = tmp_path / "copy"
    copy.mkdir()
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in also and (ROOT / name).exists():
            shutil.copy(ROOT / name, copy)
    shutil.copytree(ROOT / "tidewater", copy / "tidewater", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    got = subprocess.run([sys.executable, "-c", NAMES], cwd=copy, capture_output=True, text=True, timeout=300, check=False)
    assert got.returncode == 0, got.stderr
    queries, sql = (x.split() for x in got.stdout.split("--"))
    from tidewater.plans import registry

    assert queries == list(registry.QUERIES) and sql == list(registry.ORACLE_SQL)
