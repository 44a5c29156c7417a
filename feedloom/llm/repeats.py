"""Exact removal of byte strings that occur twice: column-wise construction over anchors.

Every window of WIDTH bytes has an anchor, the place of its least k-gram hash, which depends
on the window's bytes alone; so equal windows meet under equal anchors, at equal places.
Runs of windows with one anchor are narrow rows.  Runs whose whole context occurs twice are
repeated outright and folded to one; where an anchor has different contexts, one copy of
each is cut out of its text, and the contexts of an anchor are ordered column by column with
their common prefixes (``columns``): a window repeats if it shares WIDTH bytes with a
neighbour.  Anchors with over BIG different contexts are not ordered in one task; their
windows are counted by 128-bit digest, with partial sums before the shuffle.

Texts are shuffled twice, to cut out contexts and to cut out what is removed; all else is
narrow rows.  Contexts are compared by a 64-bit hash under an equal 64-bit anchor hash.

Defined cases: a null text is empty; nothing matches in texts below WIDTH bytes; repeated
rows are documents of their own and remove each other; null doc_id rows take part; an empty
table gives an empty result.  Very long texts are cut into windows in parts of bounded size;
columns besides doc_id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .anchors import GRAM, runs
from .columns import repeated_windows

WIDTH = 400
BIG = 20_000
AT_ONCE = 20_000  # contexts ordered at once; an anchor's contexts are never parted
KEY = ["doc", "key"]


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, raw text and a key; rows with an equal key are equal."""
    return docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64("doc_id", text).alias("key"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"),
    )


def window_runs(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc, key and the runs of each text: anchor, context, place, first, last."""

    def run(batches):
        for b in batches:
            docs, keys, raws = (b.column(i).to_pylist() for i in range(3))
            for at in range(0, len(raws), 512):
                cols: list[list] = [[] for _ in range(7)]
                for d, k, raw in zip(docs[at : at + 512], keys[at : at + 512], raws[at : at + 512]):
                    for r in runs(raw, width):
                        for c, v in zip(cols, (d, k, *r)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*KEY, "anchor", "context", "place", "first", "last"])

    long = rows.filter(F.octet_length("raw") >= width).select(*KEY, "raw")
    return long.mapInArrow(run, "doc long, key long, anchor long, context long, place long, first long, last long")


def _contexts(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted: one (doc, key, anchor, place, first, last, big, known) a context to cut out."""
    spots = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "place", "first", "last", "big", "known")).alias("spots"))  # bounded by the text
    one = rows.select(*KEY, "raw").join(spots, KEY)
    schema = "doc long, key long, anchor long, place long, first long, big boolean, known boolean, bytes binary"

    def run(batches):
        for b in batches:
            for at in range(b.num_rows):
                d, k, raw, spots = (b.column(i)[at].as_py() for i in range(4))
                cols = list(zip(*[
                    (d, k, s["anchor"], s["place"], s["first"], s["big"], s["known"], raw[s["first"] : s["last"] + width]) for s in spots
                ]))
                kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[*KEY, "anchor", "place", "first", "big", "known", "bytes"])

    return one.mapInArrow(run, schema)


_SPANS = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _ordered(width: int):
    """Spans of repeated windows, from contexts sorted by anchor."""

    def flush(cols):
        doc, key, anchor, place, first, known, texts = cols
        anchor, place, first = np.array(anchor), np.array(place), np.array(first)
        hits = repeated_windows(anchor, texts, place - first, width, width - GRAM + 1)
        hits[np.array(known, bool)] = False
        edge = np.diff(np.pad(hits, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (i, near), (_, far) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        start, end = place[i] - far + 1, place[i] - near + width
        return pa.RecordBatch.from_arrays([pa.array(np.array(doc)[i]), pa.array(np.array(key)[i]), pa.array(start), pa.array(end)], schema=_SPANS)

    def run(batches):
        held: list[list] = [[] for _ in range(7)]
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                for c, x in zip(held, part.columns):
                    c.extend(x.to_pylist())
                if len(held[2]) >= AT_ONCE:
                    last = held[2][-1]
                    cut = next((i for i in range(len(held[2]) - 1, -1, -1) if held[2][i] != last), -1) + 1
                    if cut:
                        yield flush([c[:cut] for c in held])
                        held = [c[cut:] for c in held]
        if held[2]:
            yield flush(held)

    return run


def _digests(width: int):
    """(digest, doc, key, start) of every window of a context."""

    def run(batches):
        names = ["digest", "doc", "key", "start", "known"]
        for b in batches:
            for at in range(b.num_rows):
                d, k, _, _, first, _, known, text = (x[at].as_py() for x in b.columns)
                n = len(text) - width + 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([xxhash.xxh3_128_digest(text[i : i + width]) for i in range(n)], pa.binary()), pa.array([d] * n, pa.int64()),
                    pa.array([k] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array([known] * n, pa.bool_()),
                ], names=names)

    return run


def repeated_spans(rows: DataFrame, width: int = WIDTH, big: int = BIG) -> DataFrame:
    """(doc, key, start, end): spans, overlapping or not, that cover all repeated windows."""
    found = settle(window_runs(rows, width))
    one = F.min(F.struct(*KEY, "place", "first", "last")).alias("one")
    folded = settle(found.groupBy("anchor", "context").agg(F.count("*").alias("n"), one))
    per = settle(folded.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1"))
    twice = folded.filter("n > 1").select("anchor", "context")
    outright = found.join(twice, ["anchor", "context"], "left_semi").select(*KEY, F.col("first").alias("start"), (F.col("last") + width).alias("end"))
    wanted = folded.join(per, "anchor").select("anchor", "one.*", (F.col("contexts") > big).alias("big"), (F.col("n") > 1).alias("known"))
    cut = settle(_contexts(rows, wanted, width))
    small = cut.filter("not big").select(*KEY, "anchor", "place", "first", "known", "bytes")
    compared = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_ordered(width), "doc long, key long, start long, end long")
    spans = outright.unionAll(compared)
    crowded = cut.filter("big")
    if not crowded.isEmpty():
        windows = settle(crowded.mapInArrow(_digests(width), "digest binary, doc long, key long, start long, known boolean"))
        again = windows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
        hit = windows.filter("not known").join(again, "digest", "left_semi")
        spans = spans.unionAll(hit.select(*KEY, "start", (F.col("start") + width).alias("end")))
    return spans


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def _cut_out(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            cols: list[list] = [[] for _ in range(5)]
            for raw, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                gone = merged([(s["start"], s["end"]) for s in spans or []])
                kept, last = [], 0
                for a, z in gone:
                    kept.append(raw[last:a])
                    last = z
                left = b"".join([*kept, raw[last:]]) if gone else raw
                for c, v in zip(cols, (len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left)):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, big: int = BIG) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left) of each row."""
    rows = keyed(docs, text)
    spans = repeated_spans(rows, width, big)
    # Fewer rows first: touching spans of one text are merged when they are cut out.
    per_doc = settle(spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("spans")))  # bounded by the text
    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(per_doc, KEY, "left").select("doc_id", "raw", "spans")
    return joined.mapInArrow(_cut_out, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
