import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 110
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_needs_the_operators(tmp_path):
    """Without the subpackage and the pipeline the entry imports, with all other queries."""
    root = Path(__spark_entry__.__file__).parent
    for p in root.rglob("*.py"):
        at = p.relative_to(root)
        if "llm" not in at.parts and at.name != "corpus_pipeline.py":
            (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / at).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
