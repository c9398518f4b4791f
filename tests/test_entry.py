import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_keys():
    q, s = entry.queries(), entry.oracle_sql()
    assert len(q) > 100 and set(s) <= set(q)
    assert "basket_pairs_flagship" in q and "p4_found" in q


def test_nothing_else_imports_the_llm_package():
    for p in ROOT.rglob("*.py"):
        rel = p.relative_to(ROOT)
        if rel.parts[:2] == ("quarry", "llm") or rel.parts[:2] == ("tests", "llm") or rel.name == "__spark_entry__.py":
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("quarry.llm") for n in names), rel


def test_no_local_checkpoints():
    assert not any(".localCheckpoint(" in p.read_text() for p in (ROOT / "quarry").rglob("*.py"))


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["body", "head", "supp"] and df.count() > 0
