"""The driver's entry points with the training-data folders deleted."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sorted(set(o) - set(q)), [n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'])"


def test_entry_without_the_training_data_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    for drop in ([], ["corpus_pipeline.py"]):
        for name in drop:
            os.remove(copy / name)
        out = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True, timeout=120).stdout
        assert out.strip().endswith("[] []") and int(out.split()[0]) > 100
