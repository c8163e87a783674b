"""The entry stands without the subpackage that nothing else imports."""

import pathlib
import shutil
import subprocess
import sys

import pytest

TOP = pathlib.Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("fojas/llm", "tests/llm"), ("fojas/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_corpus_queries(tmp_path, gone):
    left = {str(TOP / g) for g in gone}
    skip = lambda folder, names: [n for n in names if n in (".git", "__pycache__") or str(pathlib.Path(folder) / n) in left]
    shutil.copytree(TOP, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e, check, bench; print(*sorted(e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, check=True).stdout.split()
    here = any((TOP / "fojas/llm").glob("*.py")) and "fojas/llm" not in gone
    assert "q05_grounding" in found and any(n.startswith("op") for n in found) == here
    assert ("pipeline" in found) == (here and "corpus_pipeline.py" not in gone and (TOP / "corpus_pipeline.py").exists())
