"""Sum-of-squares packing of token sequences into windows.

Documents arrive in the order in which they are read.  A document longer than a window is
cut into full windows; what is left goes, whole, to the fill level that minimises the sum
over all levels of the squared number of windows at that level.  The counts stand in one
level array; a vectorised scan of it prices every choice, opening a window included.

A task packs its own rows and numbers its windows below its own prefix, so packing needs
no shuffle and no state beyond the level array and the windows still open.  What is open
when a task ends is cut up to fill windows completely; one padded window remains.

Defined cases: a null or empty text is one end id; repeated rows are packed each; an empty
table gives an empty result; null doc_id rows are packed like others.
Very long texts fill windows of their own; columns besides doc_id and the text are not read, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, with_end

WINDOW = 4096
TOKENIZER = "word_bpe_49k.json"
TEXTS = 128
TASK_BITS = 40  # windows of one task

Piece = tuple[int, int, int, int, int, int]  # row, start, length, crc, tokens of the row, offset


class SumOfSquares:
    """Windows of ``size`` with a level array: ``open[h]`` counts windows filled to ``h``."""

    def __init__(self, size: int = WINDOW):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)
        self.at: list[list[list]] = [[] for _ in range(size)]  # windows by level, last opened last

    def put(self, length: int, item) -> list | None:
        """Place an item; the window, as a list of (item, offset), if it is full now."""
        size, n = self.size, self.count
        top = size - length
        # growth of the sum when a window goes from h to h + length (a full window counts nothing)
        gain = 2 * n[length : size + 1] - 2 * n[: top + 1] + 2
        gain[0] = 2 * n[length] + 1  # a new window
        gain[top] = 1 - 2 * n[top] if top else 0
        gain[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        h = int(gain.argmin())
        window = self.at[h].pop() if h else []
        if h:
            n[h] -= 1
        window.append((item, h))
        if h + length == size:
            return window
        n[h + length] += 1
        self.at[h + length].append(window)
        return None

    def rest(self) -> Iterator[tuple[int, list]]:
        """(fill, window) of what is still open, fullest first."""
        for h in range(self.size - 1, 0, -1):
            for window in self.at[h]:
                yield h, window


def _pieces(batches, size: int, name: str, width: int):
    """Rows of _row, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    task = TaskContext.get().partitionId() << TASK_BITS
    made, packer, encoder = 0, SumOfSquares(size), Encoder.of(name)
    out: list[tuple] = []
    keep: list = []

    def emit(row, start, ids, total, window, offset):
        out.append((start, len(ids), zlib.crc32(ids.tobytes()), total, task + window, offset))
        keep.append(row)

    def drain():
        cols = list(zip(*out))
        rows = [pa.array([k[i] for k in keep], kinds[i]) for i in range(width)]
        batch = pa.RecordBatch.from_arrays(rows + [pa.array(c, pa.int64()) for c in cols], names=names)
        out.clear(), keep.clear()
        return batch

    names: list[str] = []
    for batch in batches:
        names = batch.schema.names[:width] + ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        kinds = [batch.schema.field(i).type for i in range(width)]
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            heads = list(zip(*[part.column(i).to_pylist() for i in range(width)])) if width else [()] * part.num_rows
            for row, short in zip(heads, encoder.encode(part.column(width).to_pylist())):
                ids = with_end(short)
                whole = len(ids) - len(ids) % size
                for start in range(0, whole, size):
                    emit(row, start, ids[start : start + size], len(ids), made, 0)
                    made += 1
                if whole < len(ids):
                    full = packer.put(len(ids) - whole, (row, whole, ids[whole:].copy(), len(ids)))
                    if full:
                        for (r, s, x, n), offset in full:
                            emit(r, s, x, n, made, offset)
                        made += 1
            if len(out) >= 4096:
                yield drain()
    fill = 0
    for _, window in packer.rest():
        for (r, s, x, n), _ in window:
            while len(x):
                take = x[: size - fill]
                emit(r, s, take, n, made, fill)
                s, x, fill = s + len(take), x[len(take) :], fill + len(take)
                if fill == size:
                    made, fill = made + 1, 0
        if len(out) >= 4096:
            yield drain()
    if out:
        yield drain()


def pack(docs: DataFrame, text: str = "text", size: int = WINDOW, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence is its pieces by offset; it holds ``size`` ids, but for the last of a task,
    which is padded.
    """
    rows = docs.select("doc_id", F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    fields = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(lambda b: _pieces(b, size, tokenizer, 1), f"doc_id {kind}, {fields}")
