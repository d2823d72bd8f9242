"""The entry on a copy of the repository without the optional training-data folders."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n == 'pipeline' or n[:2] == 'op' and n[2].isdigit() for n in e.queries()))"


def _listed(folder, code=LIST):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


def _copy(tmp_path, *left_out):
    folder = tmp_path / "copy"
    shutil.copytree(ROOT, folder, ignore=lambda d, names: [n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(d, n), ROOT) in left_out])
    return folder


def test_entry_without_the_folders(tmp_path):
    """With corpus_pipeline.py still there, and without it."""
    for i, out in enumerate((("supportkb/llm", "tests/llm"), ("supportkb/llm", "tests/llm", "corpus_pipeline.py"))):
        ran = _listed(_copy(tmp_path / str(i), *out))
        assert ran.returncode == 0, ran.stderr
        queries, twins, optional = ran.stdout.split()
        assert int(queries) >= 108 and int(twins) >= 106 and optional == "False"


def test_entry_raises_errors_inside_the_folders(tmp_path):
    folder = _copy(tmp_path)
    if not (folder / "supportkb" / "llm").is_dir():
        return
    with open(folder / "supportkb" / "llm" / "queries.py", "a") as f:
        f.write("\nimport no_such_module_of_ours\n")
    assert "no_such_module_of_ours" in _listed(folder).stderr
