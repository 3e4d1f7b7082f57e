"""The entry module without its optional part, in copies of the repository."""

import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

ASK = "import sys; {}import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, any(n.startswith('op1_') for n in q), set(o) <= set(q))"


def ask(folder, before=""):
    done = subprocess.run([sys.executable, "-c", ASK.format(before)], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "", "PYTHONPATH": str(folder), "HOME": str(folder)}, check=False)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


@pytest.fixture
def bare(tmp_path):
    shutil.copytree(f"{ROOT}/loomline", tmp_path / "loomline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    return tmp_path


def test_without_the_optional_part(bare):
    n, n_sql, *flags = ask(bare)
    assert int(n) > 250 and int(n_sql) > 200 and flags == ["False", "False", "True"]


def test_with_leftovers_of_the_optional_part(bare):
    (bare / "loomline" / "llm" / "__pycache__").mkdir(parents=True)
    (bare / "corpus_pipeline.py").write_text("from loomline.llm.common import Written\n")
    assert ask(bare)[2:] == ["False", "False", "True"]


def test_without_the_tokenizers():
    assert ask(ROOT, "sys.modules['public_tokenizers'] = None; ")[2:] == ["False", "False", "True"]
