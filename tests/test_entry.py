"""The driver's contract holds with and without the optional subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent
LISTING = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


def listed(folder: Path) -> tuple[list[str], list[str]]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", LISTING], cwd=folder, env=env, capture_output=True, text=True, check=True)
    queries, oracles = said.stdout.strip("\n").split("\n")
    return queries.split(), oracles.split()


def copied(folder: Path, *gone: str) -> Path:
    for name in ("gridstats", "__spark_entry__.py", "corpus_pipeline.py"):
        source = HERE / name
        if source.is_dir():
            shutil.copytree(source, folder / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, folder / name)
    for name in gone:
        path = folder / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    return folder


def test_the_rest_lives_without_the_subpackage(tmp_path):
    from gridstats import plans

    for k, gone in enumerate((("gridstats/llm",), ("gridstats/llm", "corpus_pipeline.py"))):
        (folder := tmp_path / str(k)).mkdir()
        queries, oracles = listed(copied(folder, *gone))
        assert queries == sorted(plans.QUERIES) and oracles == sorted(plans.ORACLE)


def test_nothing_outside_imports_the_subpackage():
    files = [p for p in (HERE / "gridstats").rglob("*.py") if "llm" not in p.relative_to(HERE).parts]
    assert files and not [p for p in files if "gridstats.llm" in p.read_text()]
