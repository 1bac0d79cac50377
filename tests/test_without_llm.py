"""The rest must import and run when the optional subpackage is gone."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "idiomark"), tmp_path / "idiomark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'verdict' in q and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    for left_over in (False, True):
        if left_over:  # an empty folder is still a namespace package
            (tmp_path / "idiomark" / "llm" / "__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "idiomark")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "idiomark.llm" not in f.read(), n
