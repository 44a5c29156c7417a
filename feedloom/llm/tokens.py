"""Token ids through the public tokenizers, with a cache of words.

A tokenizer that splits its input before it merges gives the same ids for a text as for its
pieces one after another, where the pieces are cut before white space (byte-level, the
space belongs to the next word) or at it (white space dropped).  Most words of a corpus
repeat, so each new word is encoded by the library once and kept; what is new in a batch
goes to the library as one text, whose tokens tell where a word begins or ends.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

END = 2  # appended to each document
_ODD_KINDS = ("Zs", "Zl", "Zp", "Nl", "No", "Mn", "Mc", "Me", "Cn")
LONG_PIECE = 4096
CACHE_WORDS = 1_200_000  # entries held by a Python worker before it starts anew
# White space of other kinds, numbers that look like letters, combining marks, and what this
# Python's Unicode does not know (the library's may): a text that holds one, or the content of
# an added token, goes to the library whole.  Characters are looked at when they first come; a table
# of all of them would take 130 MB of every worker.
class _Odd:
    def __init__(self):
        self._plain = {" "}  # characters that have come and are not odd

    def __contains__(self, c: str) -> bool:
        return c in "\x00\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" or c != " " and unicodedata.category(c) in _ODD_KINDS

    def isdisjoint(self, text: str) -> bool:
        if self._plain.issuperset(text):
            return True
        new = set(text) - self._plain
        odd = set(filter(self.__contains__, new))
        self._plain |= new - odd
        return not odd


_ODD = _Odd()
_PIECES = {  # letters with the blank before them, or what lies between
    True: re.compile(r" ?[^\W\d_]+|(?:(?! ?[^\W\d_])[\s\S])+"),
    False: re.compile(r"[^\W\d_]+|(?:(?![^\W\d_])\S)+"),
}
_WORDS = {True: re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+"), False: re.compile(r"\S+")}

_loaded: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts by one tokenizer file; ids must fit 16 bits to be cached as bytes."""

    def __init__(self, name: str, cache_words: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(public_tokenizers.path(name))
        self.limit = cache_words
        size = self.lib.get_vocab_size(with_added_tokens=True)
        assert size <= 1 << 16
        names = [self.lib.id_to_token(i) or "" for i in range(size)]
        self.word_end = np.array([n.endswith("</w>") for n in names])
        self.byte_level = not self.word_end.any()
        self.word_start = np.array([n.startswith("Ġ") for n in names])
        self.parts, self.words = _PIECES[self.byte_level], _WORDS[self.byte_level]
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, name: str) -> Encoder:
        """One encoder per worker process, kept between tasks."""
        if name not in _loaded:
            _loaded[name] = cls(name)
        return _loaded[name]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, dtype=np.uint16)

    def _pieces(self, text: str) -> list[str]:
        if not _ODD.isdisjoint(text) or any(a in text for a in self.added):
            return [text]
        if "'" in text or (self.byte_level and any(x in text for x in ("  ", " \n", "\n ", "\n\n", "\t"))):
            return self.words.findall(text)  # a suffix or a run of blanks: cut at white space only
        return self.parts.findall(text)

    def _learn(self, new: list[str]) -> None:
        if self.byte_level:
            group = [p for p in new if p[0] == " " and p[1:].isalpha()]
            ids = self._ids("".join(group))
            cuts = np.append(np.flatnonzero(self.word_start[ids]), len(ids))
        else:
            group = [p for p in new if p.isalpha()]
            ids = self._ids(" ".join(group))
            cuts = np.append(0, np.flatnonzero(self.word_end[ids]) + 1)
        if group and len(cuts) == len(group) + 1 and cuts[0] == 0 and cuts[-1] == len(ids):
            raw, at = ids.tobytes(), (2 * cuts).tolist()
            self.known.update((p, raw[x:y]) for p, x, y in zip(group, at, at[1:]))
        for p in new:
            if p not in self.known:
                self.known[p] = self._ids(p).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint16 ids of each whole text (null: none), without an end id."""
        cut = [self._pieces(t) if t else [] for t in texts]
        seen = self.known
        every = set().union(*cut)
        if len(seen) + len(every) > self.limit:
            seen.clear()
        new = [p for p in every if p not in seen]
        long = [p for p in new if len(p) > LONG_PIECE]  # whole odd texts, endless words
        self._learn([p for p in new if len(p) <= LONG_PIECE] if long else new)
        seen.update((p, self._ids(p).tobytes()) for p in long)
        out = [np.frombuffer(b"".join(map(seen.__getitem__, c)), np.uint16) for c in cut]
        for p in long:
            del seen[p]
        return out


def with_end(ids: np.ndarray) -> np.ndarray:
    """Little-endian 32-bit ids of a document with its end id."""
    out = np.empty(len(ids) + 1, "<u4")
    out[:-1] = ids
    out[-1] = END
    return out
