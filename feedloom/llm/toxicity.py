"""Toxic spans and document scores from a linear-chain conditional random field.

The chain is fitted on the driver from a bounded sample of labelled rows, SAMPLE of each
class, chosen by a hash of doc_id; everything else covers all rows.  Scoring is one pass
without a shuffle: words get emission odds, forward-backward gives each word's marginal,
and a document's score is a logistic function of its expected number of offending words
and of the largest marginal.  Words at or over one half are joined to spans.

Rows whose crc32(doc_id) mod FOLDS is 0 are never learnt from.  Labels, lang, source and
doc_id are no inputs of a score.

Defined cases: a null or empty text has no words and scores as such; null doc_id is not
held out (crc32 of nothing known) and is never learnt from; repeated rows are scored each;
without labels of both classes every score is 0; an empty table gives an empty result.  Very long
texts are scored whole; further columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chain import WORD, Chain, fit
from .rows import map_texts

FOLDS = 5
SAMPLE = 1500  # rows of each class that the fit may see
SAMPLE_CHARS = 20_000  # a longer text is not chosen for the fit

_OUT = T.StructType([
    T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.LongType()), T.StructField("spans", T.StringType()),
])


def fold(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The chain fitted on at most ``sample`` labelled rows of each class."""
    y = labels.filter(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = None
    for c in (0, 1):
        # twice as many candidates as needed: some texts are null or too long
        part = y.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(2 * sample)
        chosen = part if chosen is None else chosen.unionAll(part)
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 4 * SAMPLE rows at most
        .filter(F.length("text").between(1, SAMPLE_CHARS))
    )
    got = [p for c in (0, 1) for p in rows.filter(F.col("toxic") == c).orderBy(order, "doc_id", "text").limit(sample).collect()]
    return fit([r["text"] for r in got], [int(r["toxic"]) for r in got])


def _score(chain: Chain):
    def run(texts):
        for t, p in zip(texts, chain.marginals([(t or "").split() for t in texts])):
            hits = (p >= 0.5).nonzero()[0].tolist()
            spans: list[list[int]] = []
            if hits:
                at = [m.span() for m in WORD.finditer(t)]
                for i in hits:
                    if spans and spans[-1][2] == i - 1:
                        spans[-1][1:] = [at[i][1], i]
                    else:
                        spans.append([*at[i], i])
            yield chain.rate(p), len(spans), ",".join(f"{a}:{z}" for a, z, _ in spans)

    return run


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_spans, spans (code points, end exclusive)."""
    s = map_texts(docs, text, _score(chain), _OUT, ["doc_id"], rows=1024)
    return s.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_spans", "spans",
    )
