import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LISTS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(' '.join(sorted(q)))"


@pytest.mark.parametrize("kept_pipeline", [True, False])
def test_queries_survive_the_deletion_of_the_corpus_part(tmp_path, kept_pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.json", "metastore_db", "spark-warehouse"))
    if not kept_pipeline:
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    found = subprocess.run([sys.executable, "-c", LISTS], cwd=copy, capture_output=True, text=True, check=True).stdout.split()
    assert "asof_nearest_flagged" in found and not [name for name in found if name == "pipeline" or name.startswith("op1")]
    for name in ("tests", "strandline"):
        assert not (copy / name / "llm").exists()
    imported = "import pkgutil, importlib, strandline; [importlib.import_module(m.name) for m in pkgutil.walk_packages(strandline.__path__, 'strandline.')]"
    subprocess.run([sys.executable, "-c", imported], cwd=copy, check=True)
