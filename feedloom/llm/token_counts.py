"""Token counts of documents without token ids.

A byte-level tokenizer cuts a text into pre-tokens first and merges inside each, so the number
of tokens of a text is the sum over its pre-tokens.  One pass counts the distinct pre-tokens of
the corpus; each goes to the library once, which says how many pieces it makes.  A second pass
takes every document's pre-token frequencies and joins them with those numbers: the most
used pre-tokens, HEAD at most, are looked up in the task (their table is sent to it), all
others leave it as rows (text digest, pre-token, frequency) for a shuffled join and are summed
per digest.  No ids are made and no text leaves its task.

The cut is the library's own: texts without odd letters are cut by the same pattern here, any
other by the library's pre-tokenizer.  Strings of added tokens are one token, as by default.

Defined cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted each,
null doc_ids are kept; very long texts are cut at blanks between letters and read in parts; an
empty table gives an empty result; columns besides doc_id and the text are not read, whatever
their names.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .rows import map_texts, most
from .tokens import _ODD

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
HEAD = 300_000  # pre-tokens looked up in the task; the others are joined
HELD = 200_000  # distinct pre-tokens a task holds before it lets them go to the shuffle
LONG = 1 << 20  # characters of a text cut at once
_CUT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_SAFE = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")  # a pre-token ends here, whatever is around

_loaded: dict[str, Cutter] = {}


class Cutter:
    """Pre-tokens of texts, and how many pieces each makes, by one tokenizer file."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(public_tokenizers.path(name))
        if self.lib.normalizer is not None:
            raise ValueError(f"{name} changes texts before it cuts them; its pre-tokens are not part of the text")
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.split = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None

    @classmethod
    def of(cls, name: str) -> Cutter:
        """One per worker process, kept between tasks."""
        if name not in _loaded:
            _loaded[name] = cls(name)
        return _loaded[name]

    def _plain(self, text: str) -> list[str]:
        if _ODD.isdisjoint(text):
            return _CUT.findall(text)
        return [text[a:z] for _, (a, z) in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def _spans(self, text: str) -> Iterator[list[str]]:
        at = 0
        while len(text) - at > LONG and (m := _SAFE.search(text, at + LONG)):
            yield self._plain(text[at : m.start()])
            at = m.start()
        yield self._plain(text[at:] if at else text)

    def cut(self, text: str | None) -> Iterator[list[str]]:
        """Lists of pre-tokens that make up the whole text."""
        if not text:
            return
        if self.split and any(a in text for a in self.added):
            for part in self.split.split(text):
                if part in self.added:
                    yield [part]
                elif part:
                    yield from self._spans(part)
        else:
            yield from self._spans(text)

    def pieces(self, cut: list[str]) -> list[int]:
        return [len(e.ids) for e in self.lib.encode_batch(cut, add_special_tokens=False)]


def used_pretokens(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(piece, uses): every distinct pre-token of the corpus and how often it occurs."""

    def run(batches):
        cutter, held = Cutter.of(tokenizer), Counter()

        def out():
            batch = pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["piece", "uses"]
            )
            held.clear()
            return batch

        for batch in batches:
            for t in batch.column(0):
                for part in cutter.cut(t.as_py()):
                    held.update(part)
                if len(held) >= HELD:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.col(text)).mapInArrow(run, "piece string, uses long")
    return rows.groupBy("piece").agg(F.sum("uses").alias("uses"))


def counted_pretokens(used: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``used`` with ``n``: into how many tokens the library cuts each pre-token."""

    def run(batches):
        cutter = Cutter.of(tokenizer)
        for batch in batches:
            n = pa.array(cutter.pieces(batch.column(0).to_pylist()), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=["piece", "uses", "n"])

    return used.mapInArrow(run, "piece string, uses long, n int")


def _summed(docs: DataFrame, head: dict[str, int], tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, known (tokens of pre-tokens in ``head``), digest and the rest of the frequencies."""
    sent = docs.sparkSession.sparkContext.broadcast(head)
    rest = T.ArrayType(T.StructType([T.StructField("piece", T.StringType()), T.StructField("f", T.LongType())]))
    out = T.StructType(
        [T.StructField("known", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("rest", rest)]
    )

    def of(texts):
        cutter, n_of = Cutter.of(tokenizer), sent.value.get
        for t in texts:
            known, rest = 0, Counter()
            for part in cutter.cut(t):
                for piece, f in Counter(part).items():
                    n = n_of(piece)
                    if n is None:
                        rest[piece] += f
                    else:
                        known += n * f
            digest = xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) if rest else None
            yield known, digest, [{"piece": p, "f": f} for p, f in rest.items()] or None

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return map_texts(rows, "text", of, out, ["doc_id", "n_bytes"])


def count_tokens(
    docs: DataFrame, text: str = "text", limit: int = LIMIT, tokenizer: str = TOKENIZER, head: int = HEAD
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    rows = docs.select("doc_id", F.col(text).alias("text"))
    counted = settle(counted_pretokens(used_pretokens(rows, tokenizer=tokenizer), tokenizer))
    first, whole = most(counted, "uses", head)
    first = first.select("piece", "n").toArrow()
    made = _summed(rows, dict(zip(first.column(0).to_pylist(), first.column(1).to_pylist())), tokenizer)
    total = F.col("known")
    if not whole:  # rare pre-tokens: equal texts once, by digest
        made = settle(made)
        parts = made.filter("digest is not null").select("digest", F.explode("rest").alias("r"))
        parts = parts.groupBy("digest", F.col("r.piece").alias("piece")).agg(F.max("r.f").alias("f"))
        sums = parts.join(counted, "piece").groupBy("digest").agg(F.sum(F.col("f") * F.col("n")).alias("more"))
        made = made.join(sums, "digest", "left")
        total = total + F.coalesce("more", F.lit(0))
    made = made.select("doc_id", "n_bytes", total.alias("n_tokens"))
    return made.withColumn("over_limit", F.col("n_tokens") > limit)
