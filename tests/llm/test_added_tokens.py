"""A text that holds the content of an added token gets the ids of the plain library call."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from feedloom.llm.tokens import Encoder

TEXTS = [
    "end of page <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b  c\n<|startoftext|>d", "It's <|endoftext|>'s",
    "<|ENDOFTEXT|> <|endof text|>", "plain words only", "<|endoftext|> " + "x" * 5000, None, "",
]


@pytest.mark.parametrize("name, end", [("byte_bpe_50k.json", 50256), ("word_bpe_49k.json", 49407)])
def test_plain_call(name, end):
    lib = Tokenizer.from_file(public_tokenizers.path(name))
    got = [x.tolist() for x in Encoder(name).encode(TEXTS)]
    assert got == [lib.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert end in got[0]
