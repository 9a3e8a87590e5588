"""The driver contract, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_corpus_operators(tmp_path):
    home = tmp_path / "repo"
    shutil.copytree(ROOT / "catalogcheck", home / "catalogcheck", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", home)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') for k in q), list(q)"
    subprocess.run([sys.executable, "-c", code], cwd=home, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(home)}, timeout=120)
