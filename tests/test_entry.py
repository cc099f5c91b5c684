"""The entry module with and without the training-data package."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def _names(root: Path) -> list[str]:
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()


def test_registers_without_the_training_data_package(tmp_path):
    shutil.copytree(ROOT / "sievemark", tmp_path / "sievemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    alone = _names(tmp_path)
    assert len(alone) > 70 and "pipeline" not in alone and not any(n.startswith("op1") for n in alone)
    assert set(alone) <= set(_names(ROOT))


def test_a_broken_import_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "sievemark", tmp_path / "sievemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module")
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, capture_output=True).returncode


def test_nothing_else_imports_the_training_data_package():
    for p in (ROOT / "sievemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text().replace("sievemark.llm is", ""), p


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
