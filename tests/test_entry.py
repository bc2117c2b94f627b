"""The driver's contract, with and without the training-data subpackage."""

import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names_and_sql_agree():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


def test_core_does_not_import_the_subpackage():
    for p in (ROOT / "lectern").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text(encoding="utf-8"))):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("lectern.llm" in n for n in names), p


def test_smoke(spark):
    if Path(entry.SMOKE).exists():
        assert entry.entry(spark).count() > 0


def test_a_missing_dependency_costs_only_the_subpackage():
    """Without a module that only the training-data operators need, the core's
    queries are still there."""
    import subprocess
    import sys

    code = "import sys; sys.modules['xxhash'] = None\nimport __spark_entry__ as e\nq, o = e.queries(), e.oracle_sql()\nassert len(q) > 200 and 'p8_ids' not in q and 'p5_found' in q and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
