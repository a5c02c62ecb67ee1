"""The driver's contract, with and without the optional subpackage."""

import os
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).columns == ["target", "coupled", "weight", "support", "place"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "faultline", ".git"):
            os.symlink(f"{ROOT}/{name}", f"{tmp_path}/{name}")
    os.mkdir(f"{tmp_path}/faultline")
    for name in os.listdir(f"{ROOT}/faultline"):
        if name != "llm":
            os.symlink(f"{ROOT}/faultline/{name}", f"{tmp_path}/faultline/{name}")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'op_g10_coupling' in q and not any(n[:3] == 'op1' or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=True)


def test_nothing_else_imports_it():
    for at, _, names in os.walk(f"{ROOT}/faultline"):
        if "llm" not in at.split(os.sep):
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(f"{at}/{n}", encoding="utf-8").read(), n
