import subprocess
import sys
from pathlib import Path


def test_names_are_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-500:]
    count, known = said.stdout.split()
    assert int(count) > 200 and known == "True"
