import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert e.entry(spark).columns == ["session_id", "score"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_document_operators(tmp_path):
    for name in ("__spark_entry__.py", "seshat"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "seshat" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
