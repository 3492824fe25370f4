"""The entry points on copies of the repository with the corpus operators taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('CHECKS', *e.oracle_sql())"


def listed(folder):
    done = subprocess.run([sys.executable, "-B", "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    names, checks = (set(line.split()[1:]) for line in done.stdout.splitlines()[-2:])
    return names, checks


@pytest.mark.parametrize("gone", [("tidemark/llm", "corpus_pipeline.py"), ("tidemark/llm",)])
def test_queries_are_listed_without_the_corpus_operators(tmp_path, gone):
    for part in ("tidemark", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / part
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / part)
    for part in gone:
        target = tmp_path / part
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    names, checks = listed(tmp_path)
    assert len(names) > 150 and checks <= names
    assert not any(n.startswith("op") and n[2:3].isdigit() for n in names) and "pipeline" not in names
