"""The entry points with and without the training-data subpackage."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).parent.parent


def test_works_without_training_data(tmp_path):
    shutil.copytree(ROOT / "vectrill", tmp_path / "vectrill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_knn' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=False)
    assert done.stdout.strip() == "fine", done.stderr


def test_nothing_else_imports_training_data():
    for path in (ROOT / "vectrill").rglob("*.py"):
        if "llm" not in path.parts:
            text = path.read_text()
            assert "vectrill.llm" not in text and "from .llm" not in text and "corpus_pipeline" not in text, path
