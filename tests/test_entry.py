import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_imports_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, m = map(int, said.stdout.split())
    assert n > 90 and m > 90


def test_entry_imports_without_the_corpus_operators(tmp_path):
    """The driver may delete the subpackage and the pipeline."""
    for p in ("__spark_entry__.py", "orebed"):
        (tmp_path / p).symlink_to(ROOT / p)
    (tmp_path / "orebed").unlink()
    (tmp_path / "orebed").mkdir()
    for p in (ROOT / "orebed").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "orebed" / p.name).symlink_to(p)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(sorted(n for n in e.queries() if n[:2] == 'op' or n == 'pipeline'))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert not [n for n in eval(said.stdout) if n[2:3].isdigit() or n == "pipeline"]


def test_entry_imports_where_only_the_subpackage_is_gone(tmp_path):
    """The pipeline's file alone may stay behind, or a library that the corpus operators need may be missing."""
    (tmp_path / "orebed").mkdir()
    for p in (ROOT / "orebed").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "orebed" / p.name).symlink_to(p)
    for p in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / p).exists():
            (tmp_path / p).symlink_to(ROOT / p)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout) > 90, said.stderr


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
