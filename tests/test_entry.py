import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_everything_else_imports_without_the_training_data_folder(tmp_path):
    for p in REPO.iterdir():
        if p.name not in ("corpus_pipeline.py", "locusframe", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "locusframe").mkdir()
    for p in (REPO / "locusframe").iterdir():
        if p.name != "llm":
            (tmp_path / "locusframe" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') for n in q), q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
