"""The package stands without its training-data subpackage, and names in queries and SQL agree."""

import ast
import pathlib

import __spark_entry__ as entry

ROOT = pathlib.Path(entry.__file__).parent


def test_nothing_imports_the_training_data_subpackage():
    for p in (ROOT / "lodestar").rglob("*.py"):
        if p.parent.name == "llm":
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("lodestar.llm") for n in names), p


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "score", "similarity"]
