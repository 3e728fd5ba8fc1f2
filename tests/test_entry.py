"""The driver's entry with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

HIDDEN = """
import sys
from importlib.abc import MetaPathFinder


class Hide(MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[:2] == ["kairograph", "llm"]:
            raise ModuleNotFoundError(name, name=name)


sys.meta_path.insert(0, Hide())
import importlib.util as u

real = u.find_spec
u.find_spec = lambda name, package=None: None if name == "kairograph.llm" else real(name, package)
import __spark_entry__ as e

print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in e.queries()))
"""


def test_queries_without_the_subpackage():
    said = subprocess.run([sys.executable, "-c", HIDDEN], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    queries, oracles, optional = map(int, said.stdout.split())
    assert queries > 50 and oracles > 50 and optional == 0


def test_the_names_are_read_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=ROOT, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    queries, oracles = (set(line.split()) for line in said.stdout.splitlines())
    assert {"lint_working_note", "lint_agent_instruction", "pipeline"} <= queries and oracles - {"pipeline"} <= queries
    assert {n.split("_")[0] for n in queries if n.startswith("op") and n[2:3].isdigit()} == {f"op{k}" for k in range(1, 14)}
