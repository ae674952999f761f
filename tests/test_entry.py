import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 50
    assert all(callable(f) for f in q.values())


def test_the_rest_stands_without_the_training_subpackage(tmp_path):
    """Without llm and the pipeline, the entry imports and the other queries run; nothing else imports them."""
    for name in ("textmill", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(HERE, name)):
            (shutil.copytree if os.path.isdir(os.path.join(HERE, name)) else shutil.copy)(os.path.join(HERE, name), tmp_path / name)
    shutil.rmtree(tmp_path / "textmill" / "llm", ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'grep_count' in q and not any(k.startswith('op') for k in q), q; assert 'components' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    for folder, _, names in os.walk(tmp_path / "textmill"):
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert "llm" not in f.read(), n


def test_the_remaining_tests_run_without_the_training_subpackage(tmp_path):
    """All other test files import, and two of them pass, where both folders and the pipeline are gone."""
    for name in ("textmill", "tests"):
        shutil.copytree(os.path.join(HERE, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(HERE, "__spark_entry__.py"), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    every = run("--collect-only", "tests")
    assert every.returncode == 0 and "test_provenance.py" in every.stdout and "llm" not in every.stdout, every.stdout[-2000:]
    some = run("tests/test_control.py", "tests/test_spans.py")
    assert some.returncode == 0, some.stdout[-2000:]
