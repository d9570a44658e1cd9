"""The driver's contract."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_has_rows_and_oracles_have_queries(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["a", "b", "ab", "a1", "b2", "tp", "mi"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_optional_part(tmp_path):
    code = "import sys, __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') and '_' in k and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    (tmp_path / "lexloom").mkdir()
    for name in os.listdir(f"{ROOT}/lexloom"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{ROOT}/lexloom/{name}", tmp_path / "lexloom" / name)
    os.symlink(f"{ROOT}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
