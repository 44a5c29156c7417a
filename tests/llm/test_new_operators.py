"""Collocations, token counts and the Merkle manifest next to plain versions of themselves."""

import hashlib
import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.llm import collocations, merkle, token_counts
from feedloom.llm.token_counts import Cutter
from feedloom.llm.tokens import _ODD, Encoder

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def rows_of(df):
    return [r.asDict() for r in df.select(*FIELDS).collect()]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plain_phrases(docs, top=2000):
    f, n, out = defaultdict(Counter), Counter(), []
    for r in docs:
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split("[.,;:!?\n-\r]", (r["text"] or "").translate(LOW)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= 10}
        dead = {q for p, a in often.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= 50 * c[q]}
        rows = []
        for p, a in often.items():
            if p not in dead:
                score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=repr)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(docs):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return H(*[field(r[c]) for c in FIELDS[:-1]], field(text))

    def tree(nodes):
        rows = [nodes]
        while len(rows[-1]) > 1:
            rows.append([H(*rows[-1][i : i + 8]) for i in range(0, len(rows[-1]), 8)])
        return rows

    langs, trees, out = defaultdict(list), {}, []
    for r in docs:
        langs[r["lang"]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        langs[lang].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[lang] = tree([leaf(r, r["text"]) for r in langs[lang]])
    top = tree([trees[x][-1][0] for x in order])
    for place, lang in enumerate(order):
        for i, r in enumerate(langs[lang]):
            text, siblings = r["text"], []
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = text.translate(LOW)
            node = leaf(r, text)
            for rows, at in ((trees[lang], i), (top, place)):
                for row in rows[:-1]:
                    run, slot = row[at // 8 * 8 : at // 8 * 8 + 8], at % 8
                    siblings += run[:slot] + run[slot + 1 :]
                    node, at = H(*run[:slot], node, *run[slot + 1 :]), at // 8
            root = top[-1][0]
            out.append((r["doc_id"], trees[lang][0][i], trees[lang][-1][0], root, H(*siblings), node, node == root))
    return sorted(out, key=repr)


def plain_counts(docs):
    lib = Cutter.of(token_counts.TOKENIZER).lib
    ids = lib.encode_batch([r["text"] or "" for r in docs], add_special_tokens=False)
    return sorted(((r["doc_id"], len((r["text"] or "").encode()), len(e.ids), len(e.ids) > 1024) for r, e in zip(docs, ids)), key=repr)


@pytest.mark.parametrize("head,head_pairs", [(1 << 18, 1 << 19), (1 << 18, 12), (25, 12), (0, 0)])
def test_phrases(spark, real, head, head_pairs):
    assert got(collocations.phrases(real, head=head, head_pairs=head_pairs)) == plain_phrases(rows_of(real))


@pytest.mark.parametrize("head,tail,head_pairs", [(25, 0, 12), (0, 0, 0), (25, 40, 12), (25, 40, 1 << 19), (25, 1 << 20, 12)])
def test_phrases_of_words_sent_by_hash(real, head, tail, head_pairs):
    assert got(collocations.phrases(real, head=head, tail=tail, head_pairs=head_pairs)) == plain_phrases(rows_of(real))


def test_no_loose_cells_while_all_frequent_words_are_sent(real, monkeypatch):
    seen = []
    cells = collocations._cells
    monkeypatch.setattr(collocations, "_cells", lambda *a: seen.append(a[4]) or cells(*a))
    collocations.phrases(real, head=25)
    assert seen == [True, True]


def test_phrases_of_odd_rows(spark, docs, empty):
    many = docs.unionAll(docs).unionAll(docs)
    assert got(collocations.phrases(many)) == plain_phrases(rows_of(many))
    assert collocations.phrases(empty).count() == 0


def test_phrases_of_ties_and_first_ones(spark):
    rows = [(i, None, "en", 1, "A b. a B! c d; x y z, x y z") for i in range(10)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in FIELDS))
    assert got(collocations.phrases(df)) == plain_phrases(rows_of(df))
    assert got(collocations.phrases(df, top=2)) == plain_phrases(rows_of(df), 2)


def test_score_beyond_64_bits(spark):
    big = spark.sql("SELECT 3037000500000 AS a, 3037000500001 AS l, 4037000500000 AS r").selectExpr(f"{collocations._score('a', 'l', 'r')} AS s")
    assert big.first()["s"] == 1000000 * 3037000500000**2 // (3037000500001 * 4037000500000)


def test_words_whose_hashes_clash(spark, real, monkeypatch):
    monkeypatch.setattr(collocations, "_hash_column", lambda w: collocations.F.lit(1 << 62).cast("long"))
    assert got(collocations.phrases(real, head=3, head_pairs=3)) == plain_phrases(rows_of(real))


def test_parts_of_a_long_text(monkeypatch):
    monkeypatch.setattr(collocations, "PART", 7)
    text = "Ab cd ef gh. ij kl, mmmmmmmmmmmmmmmm n\to p" * 3
    book = collocations.Book([("en", w, 1) for w in "ab cd ef gh ij kl n o p".split()], True)
    ids = [x for x in book.encode("en", [text, text], 3)]
    whole = [w for t in (text, text) for p in re.split("[.,]", t.lower()) for w in [*p.split(), "."]]
    want = Counter(tuple(whole[i : i + 3]) for i in range(len(whole) - 2) if all(w in book.ids["en"] for w in map(str.encode, whole[i : i + 3])))
    names = list(book.ids["en"])
    have = Counter(tuple(names[x].decode() for x in a[i : i + 3]) for a in ids for i in range(len(a) - 2) if min(a[i : i + 3]) >= 0)
    assert have == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=1, max_size=200), st.sampled_from([1, 7, 1000]), st.sampled_from([0, 20, 5000]))
def test_tiles_count_pairs(pairs, tile_rows, dense):
    x, y = (np.array([p[i] for p in pairs], np.int64) for i in range(2))
    grid = collocations.Grid(np.bincount(x, minlength=41), np.bincount(y, minlength=41), tile_rows)
    kept, have = (collocations.DENSE, collocations.ALL_DENSE), Counter()
    try:
        collocations.DENSE, collocations.ALL_DENSE = dense, 2 * dense
        tiles = collocations.Tiles(grid)
        made = [*tiles.add(x, y), *tiles.add(x[:50], y[:50]), *tiles.rest()]
        for t in {t for t, _, _ in made}:
            back = [collocations.unpack(collocations.pack(c, n)) for u, c, n in made if u == t]
            cells, counts = collocations.summed(*map(list, zip(*back)), grid.cells(t))
            i, j = grid.back(t, cells)
            have.update(dict(zip(zip(i.tolist(), j.tolist()), counts.tolist())))
    finally:
        collocations.DENSE, collocations.ALL_DENSE = kept
    assert have == Counter(pairs + pairs[:50])


@pytest.mark.parametrize("head", [300_000, 40, 0])
def test_token_counts(real, docs, empty, head):
    assert got(token_counts.count_tokens(real, head=head)) == plain_counts(rows_of(real))
    assert got(token_counts.count_tokens(docs, head=head)) == plain_counts(rows_of(docs))
    assert token_counts.count_tokens(empty, head=head).count() == 0


ODD = st.one_of(st.sampled_from(" \n\t'.,ab1éß😀́ ²\x1c\x85ᲊ"), st.sampled_from(["<|endoftext|>", "'s", "  "]), st.characters(blacklist_categories=("Cs",)))


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, max_size=30).map("".join), st.sampled_from([1 << 20, 3]))
def test_pretokens_are_those_of_the_library(text, long):
    cutter, kept = Cutter.of(token_counts.TOKENIZER), token_counts.LONG
    try:
        token_counts.LONG = long
        cut = [p for part in cutter.cut(text) for p in part]
    finally:
        token_counts.LONG = kept
    assert "".join(cut) == text
    assert sum(cutter.pieces(cut)) == len(cutter.lib.encode(text, add_special_tokens=False).ids)


def test_a_tokenizer_that_changes_texts_is_refused():
    with pytest.raises(ValueError):
        Cutter("word_bpe_49k.json")


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_manifest(real, depth):
    assert got(merkle.manifest(real, depth)) == plain_manifest(rows_of(real))


def test_manifest_of_odd_rows(spark, docs, empty):
    assert got(merkle.manifest(docs, 1)) == plain_manifest(rows_of(docs))
    assert merkle.manifest(empty).count() == 0
    one = docs.limit(1)
    assert got(merkle.manifest(one)) == plain_manifest(rows_of(one))


def test_manifest_of_many_languages(spark):
    rows = [(i, "s", None if i % 30 == 0 else f"l{i % 30}" if i % 30 > 1 else "", i, f"Text {i}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(merkle.manifest(df, 1)) == plain_manifest(rows_of(df))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_around_every_kind_of_letter(name):
    """Letters alone and after others, and what this Python's Unicode does not know."""
    e = Encoder.of(name)
    kinds = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nd", "Sk", "Sm", "Sc", "So", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Cf", "Cc", "Cn"}
    cs = [c for c in map(chr, range(0x20000)) if unicodedata.category(c) in kinds]
    cs = [c for c in cs if c not in _ODD] [::5] + [c for c in cs if unicodedata.category(c) == "Cn"][::11] + ["Ᲊ", "\U00013460"]
    texts = [t for c in cs for t in (c, "A" + c, "a " + c + "b 1" + c)]
    for i in range(0, len(texts), 4000):
        want = e.lib.encode_batch(texts[i : i + 4000], add_special_tokens=False)
        for t, w, ids in zip(texts[i:], want, e.encode(texts[i : i + 4000])):
            assert ids.tolist() == w.ids, (t, sys.maxunicode)
