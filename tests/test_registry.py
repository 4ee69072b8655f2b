"""The driver contract: names, SQL for known queries only, and an import without the optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from storylake.plans import registry


def test_every_oracle_has_a_query():
    assert set(registry.oracles()) <= set(registry.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_runs(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.columns == ["doc_id", "chunk_idx", "text", "start_idx", "end_idx"] and frame.count() > 0


def test_import_without_the_optional_parts(tmp_path):
    """In a copy of the repository whose corpus operators are really gone; the pipeline's file may stay or go."""
    root = Path(__spark_entry__.__file__).parent
    left_out = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache")
    shutil.copytree(root, tmp_path / "copy", ignore=left_out)
    code = """
import __spark_entry__ as e
names = e.queries()
assert "tts_chunks" in names and set(e.oracle_sql()) <= set(names)
assert not any(n[:2] == "op" and n[2:3].isdigit() or n == "pipeline" for n in names)
"""
    for gone in ([], ["corpus_pipeline.py"]):
        for name in gone:
            (tmp_path / "copy" / name).unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path / "copy", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
