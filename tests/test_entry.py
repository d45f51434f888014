"""The driver's contract: names, schemas, and the rest without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(entry.__file__).parent


def test_every_oracle_has_a_query():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 60


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() >= 0


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    for p in ("__spark_entry__.py", "quern"):
        (shutil.copytree if (REPO / p).is_dir() else shutil.copy)(REPO / p, tmp_path / p)
    shutil.rmtree(tmp_path / "quern/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_term' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
