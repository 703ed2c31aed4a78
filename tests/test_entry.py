"""The engine without its optional corpus operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_optional_part_can_go(tmp_path):
    optional = ("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(HERE, tmp_path / "repo", ignore=lambda d, names: [n for n in names if n in optional])
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr


def test_queries_have_sql_of_known_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 50
