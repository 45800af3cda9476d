"""The driver contract and the shared folder rule."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from assocgrid import storage
from assocgrid.registry import REGISTRY


def test_registry_is_consistent():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and set(REGISTRY.queries) <= set(queries)
    assert set(REGISTRY.queries) - set(REGISTRY.sql) == {"bootstrap_ci"}


def test_flagship_schema(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "feature" and "eligible_rank" in df.columns and df.count() > 0


def test_folder_named_by_the_session_is_used(spark, tmp_path):
    class Conf:
        @staticmethod
        def get(key, default=None):
            return f"{tmp_path}/" if key == storage.CHECKPOINT_KEY else default

    class Session:
        conf = Conf

    assert storage.shared_folder(Session) == str(tmp_path)
    named = spark.conf.get(storage.CHECKPOINT_KEY, None)
    assert storage.shared_folder(spark) == named if named else storage.shared_folder(spark).startswith("/tmp/spark-")


@pytest.mark.parametrize("kept", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_optional_subpackage(tmp_path, kept):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "assocgrid", tmp_path / "assocgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *kept):
        shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'feature_screen' in q and set(s) <= set(q) and not [n for n in q if n.startswith('op')]"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)
