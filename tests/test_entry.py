import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_imports_without_the_training_data_part(tmp_path):
    """With both llm folders and the pipeline's module gone, or the folders alone, the other queries stay."""
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q); assert set(e.oracle_sql()) <= set(q)"
    for gone in (("corpus_pipeline.py",), ()):
        at = tmp_path / f"copy{len(gone)}"
        shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *gone))
        out = subprocess.run([sys.executable, "-c", code], cwd=at, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(at)})
        assert out.returncode == 0, out.stderr


def test_a_missing_module_of_another_part_is_an_error(tmp_path):
    at = tmp_path / "copy"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    (at / "corpus_pipeline.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=at, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(at)})
    assert out.returncode and "no_such_module" in out.stderr
