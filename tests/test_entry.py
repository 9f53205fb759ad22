import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_optional_subpackage():
    code = "import sys; sys.modules['flowloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(n.startswith(('p2_', 'p8_')) for n in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0


def test_nothing_else_imports_the_optional_subpackage():
    for p in (ROOT / "flowloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"flowloom\.llm|from \.+llm", p.read_text()), p
