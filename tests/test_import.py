"""The library loads without a session, and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def loaded(code: str) -> str:
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout


def test_import_without_a_session():
    assert int(loaded("import __spark_entry__ as e; print(len(e.queries()), end='')")) > 200


def test_import_without_the_operators():
    hide = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['loomtext.llm'] = None; "
    assert loaded(hide + "import __spark_entry__ as e; print(any(k.startswith('op') or k == 'pipeline' for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()), end='')") == "False True"
