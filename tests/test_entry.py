"""What the driver calls."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).parents[1]


def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_optional_parts(tmp_path):
    """The entry points work where neither the subpackage nor the pipeline is there."""
    for name in ("__spark_entry__.py", "vtable"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "vtable/llm")], check=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 80 and out[1] == "False"


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "vtable").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
