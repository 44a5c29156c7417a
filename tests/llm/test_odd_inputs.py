"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from feedloom.llm import mixing, near_copies, neighbours, packing, quality, range_coder, repeats, secret_scan, sharding, token_files, toxicity
from feedloom.llm.chain import Chain
from feedloom.llm.tokens import Encoder
from feedloom.llm.trigrams import required

WHOLE = {  # operators that return a row for every row
    "quality": quality.verdicts,
    "near_copies": near_copies.near_duplicates,
    "repeats": repeats.remove_repeats,
    "token_files": token_files.round_trip,
    "sharding": sharding.shard,
    "secrets": secret_scan.report,
    "mixing": mixing.select,
    "toxicity": lambda d: toxicity.score(d, Chain()),
}


@pytest.mark.parametrize("name", WHOLE)
def test_every_row_comes_back(docs, name):
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    assert ids(WHOLE[name](docs)) == ids(docs)


@pytest.mark.parametrize("name", WHOLE)
def test_an_empty_table(empty, name):
    assert WHOLE[name](empty).count() == 0


def test_packing_odd_rows(docs, empty):
    assert packing.pack(empty).count() == 0
    done = packing.pack(docs).groupBy().sum("length").first()[0]
    heads = packing.pack(docs).filter("start = 0")
    assert heads.count() == docs.count() and done == heads.groupBy().sum("doc_tokens").first()[0]


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.nearest(df, F.col("vec_id") % 20 == 0).count() == 0


def test_defined_results(docs):
    base = {(r["doc_id"], r["n_words"]): r for r in quality.verdicts(docs).collect()}
    assert base[(5, 0)]["base_failed"] and not base[(5, 0)]["kept"]
    prints = [r for r in near_copies.near_duplicates(docs).collect() if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in prints} == {None, 4, 5, 6} and {r["component_id"] for r in prints} == {4}
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.report(docs).collect()}
    assert spans[5] == "" and spans[11].startswith("assign:8:")
    sizes = {r["doc_id"]: r for r in sharding.shard(docs).collect()}
    assert (sizes[5]["size"], sizes[5]["text_crc32"]) == (1, 0)


def test_pipeline_stages(spark, docs, empty, sf):
    """All but the last stage return the columns they got, and their decisions take effect."""
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.dtypes == docs.dtypes, name
    assert stage(spark, empty, sf).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_keep_one_of_a_group(docs):
    kept = [r["doc_id"] for r in near_copies.keep_one(docs).select("doc_id").collect()]
    assert 1 in kept and 2 not in kept and kept.count(10) == 2 and 5 not in kept and 4 in kept


def test_redaction(docs):
    new = {(r["doc_id"], r["text"]): r for r in secret_scan.redact(docs).collect()}
    assert (10, "[assign] and [access]") in new and new[(10, "[assign] and [access]")]["n_chars"] == 21
    assert (1, docs.filter("doc_id = 1").first()["text"]) in new
    assert (5, None) in new


def test_rules_without_trigrams_scan_fully():
    assert required("[0-9a-f]{24,}") == []
    assert required("ab|c") == []
    assert required(r"(?i:Secret|token)\s*x") == [[["cre", "ecr", "ret", "sec"], ["ken", "oke", "tok"]]]


ANY = st.text(st.one_of(st.sampled_from(" \n\t'.,ab1éß😀́ ²"), st.characters(blacklist_categories=("Cs",))), max_size=40)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(ANY, max_size=4))
def test_cached_ids_are_the_library_ids(name, texts):
    e = Encoder.of(name)
    for t, got in zip(texts, e.encode(texts)):
        assert got.tolist() == e.lib.encode(t, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(blocks=st.lists(st.lists(st.integers(0, 65535), max_size=60), max_size=5), few=st.booleans())
def test_range_coder_round_trip(blocks, few):
    blocks = [np.array([x % 3 if few else x for x in b], np.uint16) for b in blocks if b]
    back = range_coder.decode(range_coder.encode(blocks), [len(b) for b in blocks])
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
