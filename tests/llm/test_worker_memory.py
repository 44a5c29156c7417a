"""What a Python worker holds before it has read anything."""

import subprocess
import sys

CODE = """
import tracemalloc
import numpy
tracemalloc.start()
from feedloom.llm import tokens
print(tracemalloc.get_traced_memory()[0])
"""


def test_odd_characters_are_no_table_of_all():
    held = int(subprocess.run([sys.executable, "-c", CODE], capture_output=True, text=True, check=True).stdout.split()[-1])
    assert held < 5e6  # with a set of all odd characters 90 MB


def test_odd_as_before():
    from feedloom.llm.tokens import _ODD, _ODD_KINDS
    import unicodedata

    every = list(map(chr, range(0, sys.maxunicode + 1, 7)))
    want = {c for c in every if c in "\x00\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" or c != " " and unicodedata.category(c) in _ODD_KINDS}
    assert {c for c in every if c in _ODD} == want
    assert {c for c in every if not _ODD.isdisjoint("a" + c)} == want
    assert _ODD.isdisjoint("") and not _ODD.isdisjoint("ab\x85")
