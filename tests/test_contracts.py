"""Rules of the repository that code review would otherwise have to watch."""

from __future__ import annotations

import pathlib
import re
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_outside_imports_the_text_subpackage():
    for path in ROOT.joinpath("driftline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"(from|import)\s+\S*\bllm\b", path.read_text()), path


def test_the_entry_imports_without_the_text_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "driftline", tmp_path / "driftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith(('op1_', 'pipeline')) for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_no_local_checkpoints():
    for path in [*ROOT.joinpath("driftline").rglob("*.py"), *ROOT.glob("*.py")]:
        assert "localCheckpoint(" not in path.read_text(), path
