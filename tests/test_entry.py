"""What the entry file offers with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


def run(code):
    return subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)


def test_without_the_subpackage_or_a_package_that_it_needs():
    from spanloom.plans import catalog

    for hidden in ("spanloom.llm", "corpus_pipeline", "xxhash", "zstandard"):
        done = run(f"import sys; sys.modules[{hidden!r}] = None\n{COUNT}")
        assert done.returncode == 0, done.stderr
        n, ops, all_ = done.stdout.split()
        # a package that is imported where it is used isn't missed here
        assert int(n) >= len(catalog.queries()) and all_ == "True" and (ops == "False" or hidden == "zstandard")


def test_nothing_else_imports_it():
    for p in (ROOT / "spanloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "spanloom").parts:
            assert "spanloom.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text()
