"""The driver's contract, with and without the optional folders."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

REPO = Path(__file__).parents[1]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"lane", "busy_s", "utilization"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("pipeline", [False, True])
def test_without_optional_folders(tmp_path, pipeline):
    """With reelgrid/llm deleted, and corpus_pipeline.py deleted or left behind."""
    shutil.copytree(REPO / "reelgrid", tmp_path / "reelgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    if pipeline and (REPO / "corpus_pipeline.py").exists():
        shutil.copy(REPO / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lane_utilization' in q and 'pipeline' not in q and not [k for k in q if k[:2] == 'op' and k[2].isdigit()]; assert set(e.oracle_sql()) <= set(q)"
    # Nothing of this repository but the copy may be found.
    path = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != REPO)
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": path})
