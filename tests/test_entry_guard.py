"""The other queries work where the training-data subpackage can't be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

from reelframe.plans import registry

ROOT = str(Path(__file__).resolve().parents[1])


@pytest.mark.parametrize("blocked", ["sentencepiece", "xxhash", "reelframe.llm", "corpus_pipeline"])
def test_queries_without(blocked):
    code = f"""
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {blocked!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import importlib.util
find = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name == {blocked!r} else find(name, package)
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(registry.queries())), str(len(registry.oracle_sql()))], out.stderr
