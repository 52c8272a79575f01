"""The rest of the library stands without the corpus operators."""

import os
import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

LEFT_OUT = (["aspectra/llm", "tests/llm"], ["aspectra/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"])


@pytest.mark.parametrize("gone", LEFT_OUT)
def test_import_without_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e, bench, tools.compare; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); print('pipeline' in q, *(n for n in q if n.startswith('op')))"
    # what else the caller's environment makes importable stays so, but for the repository itself
    others = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != str(ROOT)]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(copy), *others])}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.startswith("False")
    assert ("op1_" in done.stdout) == ("aspectra/llm" not in gone and (ROOT / "aspectra/llm").exists())


def test_errors_inside_a_part_are_not_swallowed(tmp_path, monkeypatch):
    import __spark_entry__ as entry

    (tmp_path / "broken_part.py").write_text("import no_such_module_anywhere\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry._optional("broken_part")
    assert entry._optional("absent_part") is None
