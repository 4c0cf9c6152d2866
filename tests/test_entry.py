"""The entry points, with and without the training-data package."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


LLM = ["siltstone/llm", "tests/llm"]


@pytest.mark.parametrize("gone", [LLM, [*LLM, "corpus_pipeline.py"], ["corpus_pipeline.py"]], ids=len)
def test_imports_without_the_llm_package(gone, tmp_path):
    """A copy of the repository without those folders still imports and lists the other queries, with or without the pipeline's file."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        shutil.rmtree(copy / name, ignore_errors=True) if not name.endswith('.py') else (copy / name).unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q, set(s) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    found = out.stdout.split()[-4:]
    assert int(found[0]) > 150, out.stderr
    assert found[1:] == ["0" if LLM[0] in gone or not (ROOT / LLM[0]).is_dir() else "13", "False", "True"]
