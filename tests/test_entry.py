"""The entry points with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), set(o) <= set(q), any(n.startswith('op') for n in q), 'pipeline' in q)"


def run(folder, *args):
    out = subprocess.run([sys.executable, *args], cwd=folder, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stdout + out.stderr
    return out.stdout


def copied(tmp_path, *without):
    folder = tmp_path / "repo"
    shutil.copytree(ROOT, folder, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", ".pytest_cache", *without))
    return folder


def test_everything_else_works_without_the_operators(tmp_path):
    """Also where the pipeline is still there, and where only its cached modules are left."""
    folder = copied(tmp_path, "llm")
    n, sound, operators, pipeline = run(folder, "-c", COUNT).split()
    assert int(n) > 100 and (sound, operators, pipeline) == ("True", "False", "False")
    os.makedirs(folder / "letterloom" / "llm" / "__pycache__")
    assert run(folder, "-c", COUNT).split()[1:] == ["True", "False", "False"]
    (folder / "corpus_pipeline.py").unlink(missing_ok=True)
    assert run(folder, "-c", COUNT).split()[1:] == ["True", "False", "False"]
    assert "error" not in run(folder, "-m", "pytest", "tests", "--collect-only", "-q", "-p", "no:cacheprovider").lower().splitlines()[-1]


def test_only_the_pipeline_missing(tmp_path):
    if not os.path.exists(os.path.join(ROOT, "letterloom", "llm", "queries.py")):
        return
    folder = copied(tmp_path, "corpus_pipeline.py")
    assert run(folder, "-c", COUNT).split()[1:] == ["True", "True", "False"]
