"""The entry point without what only the text operators need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def queries_without(*modules):
    block = "".join(f"sys.modules[{m!r}] = None\n" for m in modules)
    script = f"import sys\n{block}sys.path.insert(0, {str(ROOT)!r})\nimport __spark_entry__ as e\nprint(*e.queries())"
    return subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("missing", ["corpus_pipeline", "xxhash", "zstandard", "public_tokenizers"])
def test_other_queries_stay(missing):
    done = queries_without(missing)
    assert done.returncode == 0, done.stderr[-500:]
    names = done.stdout.split()
    assert "train_matrix" in names and "pipeline" not in names and not [n for n in names if n.startswith("op1_")]


def test_a_missing_part_of_the_library_is_an_error():
    done = queries_without("couponflow.functions.discount")
    assert done.returncode != 0 and "couponflow.functions.discount" in done.stderr
