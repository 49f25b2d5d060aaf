"""The driver contract, also without the folders of the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def listed(root):
    run = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=root, env={**os.environ, "PYTHONPATH": str(root)}, capture_output=True, text=True, check=True)
    queries, twins, pipeline = run.stdout.split()
    return int(queries), int(twins), pipeline == "True"


def test_entry_without_the_corpus_folders(tmp_path):
    here = tmp_path / "repo"
    shutil.copytree(ROOT, here, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    whole = listed(here)
    shutil.rmtree(here / "lattica" / "llm", ignore_errors=True)
    shutil.rmtree(here / "tests" / "llm", ignore_errors=True)
    rest = listed(here)
    assert not rest[2] and 0 < rest[0] <= whole[0] and 0 < rest[1] <= whole[1]
    if (here / "corpus_pipeline.py").exists():
        (here / "corpus_pipeline.py").unlink()
    assert listed(here) == rest
