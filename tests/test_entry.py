"""The entry module without the corpus operators, or without a library they need."""

import os
import subprocess
import sys

from conftest import ROOT

CHILD = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError("No module named " + name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print("QUERIES", *sorted(e.queries()))
"""


def _queries(name):
    out = subprocess.run([sys.executable, "-c", CHILD.format(name=name)], cwd=ROOT, capture_output=True, text=True,
                         env=os.environ | {"PYTHONPATH": ROOT})
    return out.returncode, out.stdout.split("QUERIES", 1)[-1].split()


def test_crawl_queries_need_no_corpus_library():
    from linkloom.plans.queries import QUERIES
    for name in ("ahocorasick", "public_tokenizers", "linkloom.llm", "corpus_pipeline"):
        assert _queries(name) == (0, sorted(QUERIES)), name
    assert _queries("linkloom.operators.frontier")[0] != 0
