import subprocess
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)


@pytest.mark.parametrize("absent", ["plumbline.llm", "public_tokenizers", "zstandard", "regex", "xxhash", "corpus_pipeline"])
def test_engine_queries_stay_without(absent):
    """Whatever the operators for training data lack, the engine's queries are there."""
    code = f"import sys, warnings; warnings.simplefilter('ignore'); sys.path.insert(0, {ROOT!r}); sys.modules[{absent!r}] = None; import __spark_entry__ as e; print(len([q for q in e.queries() if q.startswith('q_')]), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(out[-2]) >= 80 and int(out[-1]) >= 80
