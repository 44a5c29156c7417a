"""No string that a rule matches may fail the rule's trigram query."""

import re
from itertools import product

import pytest

from feedloom.llm.trigrams import required


@pytest.mark.parametrize("rule", ["x[ab]{5}y", "(?:ab){4}y", "xa{4}y{4}", "x[ab]{3}y", "xa{2}by", "x[ab]{2,5}y", "a{4,6}xyb", "x(?:a{5}|b{4})y"])
def test_short_strings(rule):
    clauses, found = required(rule), 0
    for n in range(1, 10):
        for s in map("".join, product("abxy", repeat=n)):
            if re.fullmatch(rule, s):
                found += 1
                assert all(any(all(t in s for t in all_of) for all_of in clause) for clause in clauses), s
    assert found
