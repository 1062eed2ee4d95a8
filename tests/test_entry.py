"""The driver's contract when the corpus operators are taken away."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q) and "RT1_bm25_topk" in q
print(len(q), sum(k.startswith("op") or k == "pipeline" for k in q))
"""


def copied(to, without):
    skip = shutil.ignore_patterns(".git", "__pycache__", *without)
    return shutil.copytree(HERE, to, ignore=skip)


def probe(folder):
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=folder, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return tuple(map(int, done.stdout.split()[-2:]))


@pytest.mark.parametrize("without", [("llm",), ("llm", "corpus_pipeline.py")])
def test_imports_without_llm(tmp_path, without):
    from lakeloom import registry

    assert probe(copied(tmp_path / "copy", without)) == (len(registry.QUERIES), 0)


def test_fails_loudly_if_llm_is_there_but_broken(tmp_path):
    folder = copied(tmp_path / "copy", ())
    if not os.path.isdir(f"{folder}/lakeloom/llm"):
        pytest.skip("no corpus operators")
    (folder / "lakeloom" / "llm" / "queries.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=folder, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "no_such_module" in done.stderr
