"""The driver contract, with and without the training-data folders."""

import importlib
import subprocess
import sys

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["module", "author", "commits", "added", "deleted", "score", "rn"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_subpackage():
    code = (
        "import sys; sys.modules['loomdoc.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; names = set(e.queries())\n"
        "assert 'contrib_leaderboard' in names and not any(n.startswith('op') or n == 'pipeline' for n in names)"
    )
    subprocess.run([sys.executable, "-c", code], check=True)


def test_no_module_imports_the_subpackage():
    from pathlib import Path

    root = Path(importlib.import_module("loomdoc").__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "loomdoc.llm" not in path.read_text(), path
