"""Phrases of two and three words that stand together more often than their parts suggest.

Words get ids by their rank of frequency in their language.  A pair of words is a cell of a
matrix that is addressed directly by the two ranks and cut into tiles; the cuts lie so that
every band of ranks has about the same number of occurrences.  A task counts tiles of few
cells densely, with bincount, until it ends; pairs of sparse tiles are counted as sorted
coordinates whenever enough of them are held.  What leaves it is one packed row a tile: the
gaps between the cells and the counts.  The rows of a tile meet in one task, which adds them
up and lets the cells of MIN or more out.  Frequent pairs are ranked anew and meet the next
word in a second matrix, so phrases of three words are pairs of (pair, word).

A phrase that occurs MIN times is made of words and pairs that do, so rarer words and pairs
end a run and nothing is lost.  HEAD words at most are sent to the tasks as they are, TAIL more
as sorted 62-bit hashes (words whose hashes clash within a language are sent by name), and
HEAD_PAIRS pairs as sorted numbers; all that was sent is tiled.  Beyond them words are counted as
sorted coordinates of all their words and summed row by row, and no run ends for a word that
was not sent.

Defined cases: a null text has no words, a null language is ``und``; a language without
phrases has no rows; repeated rows count as often as they stand; ties are broken down to the
phrase; very long texts are read in parts that overlap; an empty table gives an empty result;
columns besides the language and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .rows import most

MIN, TOP = 10, 2000
HEAD, TAIL, HEAD_PAIRS = 1 << 18, 1 << 21, 1 << 21
TILE_ROWS = 1 << 22  # occurrences that a tile should hold: it meets in one task
DENSE, ALL_DENSE = 1 << 20, 1 << 22  # cells of a tile that is counted densely; of all such tiles of a task
HELD_WORDS, HELD_PAIRS = 200_000, 1 << 20  # of a task before they are counted and let go
PART = 1 << 20  # bytes of text split at once
TEXTS, OUT = 512, 1 << 15  # texts read at once, rows of a batch that leaves a task
SEED = 42
_HASHED = 1 << 62
_ID = 31  # bits of an id of a word that was sent
_TO_MARK = bytes.maketrans(b"\t,;:!?\n\x0b\x0c\r", b" .........")
_END = b"."  # no word holds one


def _words(raw: bytes) -> list[bytes]:
    """Words in order, and ``_END`` where a piece ends; ``raw`` is lower case."""
    return raw.translate(_TO_MARK).replace(b".", b" . ").split()


def _parts(texts: list[str]) -> Iterator[bytes]:
    """The texts as lower-case UTF-8, pieces apart, cut at blanks into parts of bounded size."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        raw = t.encode("utf-8", "surrogatepass").lower()  # bytes.lower touches A-Z only
        at = 0
        while len(raw) - at > PART:
            cut = max(raw.rfind(b" ", at, at + PART), raw.rfind(b".", at, at + PART), raw.rfind(b"\n", at, at + PART))
            if cut <= at:
                cuts = [x for x in (raw.find(b" ", at + PART), raw.find(b".", at + PART), raw.find(b"\n", at + PART)) if x > 0]
                cut = min(cuts, default=len(raw))
            held.append(raw[at:cut])
            yield b"".join(held)
            held, size, at = [], 0, cut
        held += [raw[at:] if at else raw, _END]
        size += len(raw) - at
        if size > PART:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[str]]]:
    """Texts by language, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part, out = batch.slice(at, TEXTS), defaultdict(list)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if text:
                    out[lang].append(text)
            yield out


def _read(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col(text).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of every word."""

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def out():
            for lang, c in held.items():
                c.pop(_END, None)
                words = pa.array([w.decode("utf-8", "surrogatepass") for w in c], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), words, pa.array(c.values(), pa.int64())], names=["lang", "word", "f"]
                )
            held.clear()

        for texts_of in _by_lang(batches):
            for lang, texts in texts_of.items():
                for raw in _parts(texts):
                    held[lang].update(_words(raw))
            if sum(map(len, held.values())) >= HELD_WORDS:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED) >> 2 | _HASHED


def _hash_column(word: str):
    return F.shiftrightunsigned(F.xxhash64(word), 2).bitwiseOR(F.lit(_HASHED).cast("long"))  # the same: seed 42


class Book:
    """Ids of the words that are sent, by language, and whether those are all frequent ones.

    Words sent by name come first; those sent by hash have the ids after them, in the order of the hashes.
    """

    def __init__(self, rows: list[tuple[str, str, int]], whole: bool, tail: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        """``tail``: rising hashes and occurrences of the words sent by hash."""
        tail = tail or {}
        self.whole, self.ids, mass = whole, defaultdict(dict), defaultdict(list)
        for lang, word, f in rows:  # by falling frequency
            ids = self.ids[lang]
            ids[word.encode("utf-8", "surrogatepass")] = len(ids)
            mass[lang].append(f)
        self.tail = {lang: h for lang, (h, _) in tail.items()}
        none = np.empty(0, np.int64)
        # occurrences by id
        self.mass = {x: np.concatenate([np.array(mass[x], np.int64), tail.get(x, (none, none))[1]]) for x in {*mass, *tail}}
        self.size = {lang: len(f) for lang, f in self.mass.items()}

    def __getstate__(self):
        return self.__dict__ | {"mass": None}  # no task reads it

    def _placed(self, lang: str, x: np.ndarray, other) -> np.ndarray:
        """Ids of hashes of words, ``other`` where they were not sent."""
        tail = self.tail.get(lang)
        if tail is None or not len(tail):
            return np.broadcast_to(other, len(x))
        at = np.minimum(np.searchsorted(tail, x), len(tail) - 1)
        return np.where(tail[at] == x, at + len(self.ids[lang]), other)

    def inner(self, lang: str, x: np.ndarray) -> np.ndarray:
        """The ids used in a task of words named by id or hash; all of them were sent."""
        return np.where(x >= _HASHED, self._placed(lang, x, x), x)

    def outer(self, lang: str, x: np.ndarray) -> np.ndarray:
        """The name of a word outside the tasks: its id if it was sent as it is, else its hash."""
        tail, n = self.tail.get(lang), len(self.ids[lang])
        if tail is None or not len(tail):
            return x
        return np.where((x >= n) & (x < _HASHED), tail[np.clip(x - n, 0, len(tail) - 1)], x)

    def encode(self, lang: str, texts: list[str], width: int) -> Iterator[np.ndarray]:
        """Ids, -1 where a run ends; each array begins with the last ``width - 1`` ids of the one before."""
        get, before = self.ids[lang].get, np.empty(0, np.int64)
        for raw in _parts(texts):
            words = _words(raw)
            if self.whole and lang not in self.tail:
                made = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            else:
                ids = (-1 if w == _END else x if (x := get(w)) is not None else _hash(w) for w in words)
                made = np.fromiter(ids, np.int64, len(words))
                far = np.flatnonzero(made >= _HASHED)
                made[far] = self._placed(lang, made[far], -1 if self.whole else made[far])
            made = np.concatenate([before, made])
            before = made[len(made) - min(width - 1, len(made)) :]
            yield made


class Grid:
    """A matrix of ranks cut into tiles; bands of ranks hold about the same mass."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, tile_rows: int = TILE_ROWS):
        """``rows``, ``cols``: occurrences by rank."""
        bands = max(1, int(np.ceil(np.sqrt(rows.sum() / tile_rows))))
        self.row, self.col = self._cuts(rows, bands), self._cuts(cols, bands)

    @staticmethod
    def _cuts(mass: np.ndarray, bands: int) -> np.ndarray:
        """First ranks of the bands, and one past the last rank."""
        total = np.cumsum(mass)
        at = np.searchsorted(total, total[-1] * np.arange(1, bands) / bands) + 1
        return np.unique(np.r_[0, at, len(mass)])

    def place(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tile, cell in it) of each pair."""
        bx, by = np.searchsorted(self.row, x, "right") - 1, np.searchsorted(self.col, y, "right") - 1
        return bx * (len(self.col) - 1) + by, (x - self.row[bx]) * (self.col[by + 1] - self.col[by]) + y - self.col[by]

    def _bands(self, tile: int) -> tuple[int, int]:
        return divmod(tile, len(self.col) - 1)

    def cells(self, tile: int) -> int:
        bx, by = self._bands(tile)
        return int((self.row[bx + 1] - self.row[bx]) * (self.col[by + 1] - self.col[by]))

    def back(self, tile: int, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bx, by = self._bands(tile)
        wide = int(self.col[by + 1] - self.col[by])
        return cell // wide + self.row[bx], cell % wide + self.col[by]


def pack(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising cells and their counts as bytes, the bytes of equal weight side by side."""
    gaps = np.diff(cells, prepend=0)
    both = np.concatenate([gaps, counts]).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(both.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1).T
    both = np.ascontiguousarray(both).view("<u8").ravel().astype(np.int64)
    n = len(both) // 2
    return np.cumsum(both[:n]), both[n:]


def summed(cells: list[np.ndarray], counts: list[np.ndarray], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Rising distinct cells of a tile of ``wide`` cells, and the sums of their counts."""
    c, n = np.concatenate(cells), np.concatenate(counts)
    if wide <= DENSE:
        total = np.bincount(c, n, wide).astype(np.int64)  # exact up to 2 ** 53
        full = np.flatnonzero(total)
        return full, total[full]
    order = np.argsort(c, kind="stable")
    c, n = c[order], n[order]
    head = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    return c[head], np.add.reduceat(n, head)


class Tiles:
    """Counts of a task: dense tiles until it ends, sparse ones as they come; yields (tile, cells, counts)."""

    def __init__(self, grid: Grid):
        self.grid, self.dense, self.taken = grid, {}, 0

    def add(self, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        tile, cell = self.grid.place(x, y)
        order = np.lexsort((cell, tile))
        tile, cell = tile[order], cell[order]
        head = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        for at, end in zip(head.tolist(), [*head[1:].tolist(), len(tile)]):
            t, wide = int(tile[at]), self.grid.cells(int(tile[at]))
            if t not in self.dense and wide <= DENSE and self.taken + wide <= ALL_DENSE:
                self.dense[t], self.taken = np.zeros(wide, np.int64), self.taken + wide
            if t in self.dense:
                self.dense[t] += np.bincount(cell[at:end], minlength=wide)
            else:
                run = cell[at:end]
                new = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
                yield t, run[new], np.diff(np.r_[new, len(run)])

    def rest(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for t, counts in self.dense.items():
            full = np.flatnonzero(counts)
            yield t, full, counts[full]
        self.dense, self.taken = {}, 0


def sorted_counts(*cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of the columns and how often each stands."""
    order = np.lexsort(cols[::-1])
    cols = tuple(c[order] for c in cols)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    head = np.flatnonzero(new)
    return (*[c[head] for c in cols], np.diff(np.r_[head, len(order)]))


class Pairs:
    """Frequent pairs of sent words of one language: their rank by the pair, and back."""

    def __init__(self, first: np.ndarray, second: np.ndarray, mass: np.ndarray):
        key = first << _ID | second
        order = np.argsort(key)
        self.key, self.mass = key[order], mass[order]

    def __getstate__(self):
        return {"key": self.key, "mass": None}  # no task reads it

    def rank(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """-1 where the pair is not held."""
        known = (i < _HASHED) & (j < _HASHED)
        key = np.where(known, i, 0) << _ID | np.where(known, j, 0)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(known & (self.key[at] == key), at, -1)

    def back(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.key[rank] >> _ID, self.key[rank] & ((1 << _ID) - 1)


_LOOSE = -1  # the tile of cells that are rows of their own


def _cells(docs: DataFrame, width: int, take, grids: dict[str, Grid], whole: bool, name) -> DataFrame:
    """(lang, i, j[, k], a) of the cells with MIN or more.

    ``take`` makes of texts (x, y, columns of words): ranks in the language's grid, or -1 and the
    words themselves; ``name`` gives the words of ranks (x, y).  ``whole``: there is no such row.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(grids)
    names = ["i", "j", "k"][:width]
    fields = "lang string, tile long, cells binary, " + "".join(f"{c} long, " for c in names) + "a long"
    kinds = [pa.string(), pa.int64(), pa.binary()] + [pa.int64()] * (width + 1)
    labels = ["lang", "tile", "cells", *names, "a"]

    def run(batches):
        tiles: dict[str, Tiles] = {}
        held: dict[str, list] = defaultdict(list)
        out: list[tuple] = []

        def packed(lang, made):
            out.extend((lang, t, pack(c, n), *[None] * width, None) for t, c, n in made)

        def drain():
            for lang, parts in held.items():
                x, y, *words = (np.concatenate(c) for c in zip(*parts))
                known = x >= 0
                if known.any():
                    if lang not in tiles:
                        tiles[lang] = Tiles(sent.value[lang])
                    packed(lang, tiles[lang].add(x[known], y[known]))
                if not known.all():
                    *cols, n = sorted_counts(*[w[~known] for w in words])
                    for at in range(0, len(n), OUT):
                        rows = [pa.array(np.ascontiguousarray(c[at : at + OUT], np.int64)) for c in (*cols, n)]
                        k = len(rows[0])
                        head = [pa.array([lang] * k, pa.string()), pa.array(np.full(k, _LOOSE)), pa.nulls(k, pa.binary())]
                        yield pa.RecordBatch.from_arrays([*head, *rows], names=labels)
            held.clear()
            yield from let_go()

        def let_go():
            for at in range(0, len(out), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[at : at + 256]), kinds)], names=labels)
            out.clear()

        n = 0
        for texts_of in _by_lang(batches):
            for lang, texts in texts_of.items():
                for cols in take(lang, texts):
                    held[lang].append(cols)
                    n += len(cols[0])
                    if n >= HELD_PAIRS:
                        yield from drain()
                        n = 0
        yield from drain()
        for lang, t in tiles.items():
            packed(lang, t.rest())
        yield from let_go()

    def add_up(batches):
        key, cells, counts, rows = None, [], [], 0

        def done():
            grid = sent.value[key[0]]
            c, n = summed(cells, counts, grid.cells(key[1]))
            often = n >= MIN
            words = name(key[0], *grid.back(key[1], c[often]))
            arrays = [pa.array([key[0]] * int(often.sum()), pa.string()), *[pa.array(np.ascontiguousarray(w, np.int64)) for w in words], pa.array(n[often])]
            return pa.RecordBatch.from_arrays(arrays, names=["lang", *names, "a"])

        for batch in batches:
            for lang, tile, raw in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (lang, tile) != key:
                    if key is not None:
                        yield done()
                    key, cells, counts, rows = (lang, tile), [], [], 0
                c, n = unpack(raw)
                cells.append(c)
                counts.append(n)
                rows += len(c)
                if rows > TILE_ROWS:
                    c, n = summed(cells, counts, sent.value[lang].cells(tile))
                    cells, counts, rows = [c], [n], 0
        if key is not None:
            yield done()

    made = docs.mapInArrow(run, fields)
    if not whole:
        made = settle(made)
    tiled = made.filter(F.col("tile") != _LOOSE) if not whole else made
    tiled = tiled.select("lang", "tile", "cells").repartition("lang", "tile").sortWithinPartitions("lang", "tile")
    often = tiled.mapInArrow(add_up, "lang string, " + "".join(f"{c} long, " for c in names) + "a long")
    if whole:
        return often
    loose = made.filter(F.col("tile") == _LOOSE).groupBy("lang", *names).agg(F.sum("a").alias("a")).filter(F.col("a") >= MIN)
    return often.unionByName(loose)


def pair_counts(docs: DataFrame, book: Book) -> DataFrame:
    """(lang, i, j, a) of neighbouring words that stand together MIN times."""
    sent = docs.sparkSession.sparkContext.broadcast(book)
    grids = {lang: Grid(mass, mass) for lang, mass in book.mass.items()}

    def take(lang, texts):
        for ids in sent.value.encode(lang, texts, 2):
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            i, j = ids[:-1][ok], ids[1:][ok]
            size = sent.value.size.get(lang, 0)
            yield np.where((i < size) & (j < size), i, -1), j, *(sent.value.outer(lang, x) for x in (i, j))

    def name(lang, x, y):
        return sent.value.outer(lang, x), sent.value.outer(lang, y)

    return _cells(docs, 2, take, grids, book.whole, name)


def triple_counts(docs: DataFrame, book: Book, pairs: dict[str, Pairs], whole: bool) -> DataFrame:
    """(lang, i, j, k, a) of three words in a row that stand MIN times; ``whole``: ``pairs`` are all frequent ones."""
    sc = docs.sparkSession.sparkContext
    sent, ranked = sc.broadcast(book), sc.broadcast(pairs)
    grids = {lang: Grid(p.mass, book.mass[lang]) for lang, p in pairs.items()}

    def take(lang, texts):
        of = ranked.value.get(lang)
        if of is None and whole:
            return
        size, outer = sent.value.size.get(lang, 0), sent.value.outer
        for ids in sent.value.encode(lang, texts, 3):
            if len(ids) < 3:
                continue
            ok = (ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0)
            i, j, k = (ids[x : len(ids) - 2 + x][ok] for x in range(3))
            if of is None:
                yield np.full(len(i), -1), k, *(outer(lang, x) for x in (i, j, k))
                continue
            r = of.rank(i, j)
            if whole:
                both = (r >= 0) & (of.rank(j, k) >= 0)
                r, i, j, k = r[both], i[both], j[both], k[both]
            yield np.where(k < size, r, -1), k, *(outer(lang, x) for x in (i, j, k))

    def name(lang, x, y):
        return tuple(sent.value.outer(lang, z) for z in (*ranked.value[lang].back(x), y))

    return _cells(docs, 3, take, grids, whole, name)


def _ranked_pairs(pairs: DataFrame, book: Book, at_most: int) -> tuple[dict[str, Pairs], bool]:
    """The most frequent pairs of sent words by language, and whether those are all pairs."""
    known = pairs if book.whole else pairs.filter((F.col("i") < _HASHED) & (F.col("j") < _HASHED))
    first, whole = most(known, "a", at_most)
    rows = first.select("lang", "i", "j", "a").toArrow()
    whole = whole and rows.num_rows == pairs.count()
    made = {}
    for lang in pc.unique(rows.column(0)).to_pylist():
        i, j, a = (c.to_numpy() for c in rows.filter(pc.equal(rows.column(0), lang)).columns[1:])
        made[lang] = Pairs(book.inner(lang, i), book.inner(lang, j), a)
    return made, whole


def _tail(words: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Rising hashes and occurrences of ``words`` (lang, h, f) by language."""
    rows = words.select("lang", "h", "f").toArrow()
    made = {}
    for lang in pc.unique(rows.column(0)).to_pylist():
        h, f = (c.to_numpy() for c in rows.filter(pc.equal(rows.column(0), lang)).columns[1:])
        order = np.argsort(h)
        made[lang] = h[order], f[order]
    return made


_BIG = "CAST({} AS DECIMAL(15, 0))"


def _score(a: str, left: str, right: str) -> str:
    a, left, right = (_BIG.format(c) for c in (a, left, right))
    return f"(CAST(1000000 AS DECIMAL(7, 0)) * ({a} * {a})) div ({left} * {right})"


def phrases(docs: DataFrame, text: str = "text", head: int = HEAD, head_pairs: int = HEAD_PAIRS, top: int = TOP,
            tail: int = TAIL) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language."""
    spark = docs.sparkSession
    rows = _read(docs, text)
    counted = settle(word_counts(rows))
    often = counted.filter(F.col("f") >= MIN)
    sent, whole = most(often, "f", head)
    sent = sent.select("lang", "word", "f").toArrow()
    names = sorted(zip(*[sent.column(c).to_pylist() for c in range(3)]), key=lambda x: (-x[2], x[0], x[1]))
    hashed = {}
    if not whole:
        more, whole = most(often, "f", head + tail)
        least = min((x[2] for x in names), default=None)  # words as frequent as any of those were sent as well
        more = more if least is None else more.filter(F.col("f") < least)
        hashed = _tail(more.withColumn("h", _hash_column("word")))
        # words with a hash in common are sent by name
        named = counted.select("lang", "word", _hash_column("word").alias("h"))
        twice = settle(named.groupBy("lang", "h").count().filter("count > 1"))
        known = {x[:2] for x in names}
        clash = named.join(F.broadcast(twice), ["lang", "h"], "left_semi").collect()
        names += [(*x, 1) for x in ((r["lang"], r["word"]) for r in clash) if x not in known]
    book = Book(names, whole, hashed)
    given = [(lang, w.decode("utf-8", "surrogatepass"), i) for lang, ids in book.ids.items() for w, i in ids.items()]
    cols = [pa.array(c, k) for c, k in zip(zip(*given), (pa.string(), pa.string(), pa.int64()))] if given else [pa.array([], k) for k in (pa.string(), pa.string(), pa.int64())]
    ids = spark.createDataFrame(pa.Table.from_arrays(cols, names=["lang", "word", "id"]))
    named = settle(often.join(ids, ["lang", "word"], "left").withColumn("id", F.coalesce("id", _hash_column("word"))))

    pairs = settle(pair_counts(rows, book))
    ranked, all_pairs = _ranked_pairs(pairs, book, head_pairs)
    triples = settle(triple_counts(rows, book, ranked, whole and all_pairs))

    def word(id_: str, as_: str) -> DataFrame:
        return named.select("lang", F.col("id").alias(id_), F.col("word").alias(f"{as_}_word"), F.col("f").alias(f"{as_}_f"))

    two = settle(pairs.join(word("i", "x"), ["lang", "i"]).join(word("j", "y"), ["lang", "j"]))
    longer = triples.select("lang", "i", "j", "a").unionAll(triples.select("lang", "j", "k", "a"))
    longer = longer.groupBy("lang", "i", "j").agg(F.max("a").alias("longer"))
    short = two.join(longer, ["lang", "i", "j"], "left").filter(F.expr("longer IS NULL OR 100 * longer < 50 * a"))
    short = short.select(
        "lang", F.concat_ws(" ", "x_word", "y_word").alias("phrase"), "a", F.col("x_f").alias("l"), F.col("y_f").alias("r")
    ).withColumn("score", F.expr(_score("a", "l", "r")))
    fore = two.select("lang", "i", "j", F.col("a").alias("xy"), "x_word", "y_word", F.col("x_f").alias("x"))
    back = two.select("lang", F.col("i").alias("j"), F.col("j").alias("k"), F.col("a").alias("yz"), F.col("y_word").alias("z_word"), F.col("y_f").alias("z"))
    long = triples.join(fore, ["lang", "i", "j"]).join(back, ["lang", "j", "k"])
    long = long.withColumn("s1", F.expr(_score("a", "x", "yz"))).withColumn("s2", F.expr(_score("a", "xy", "z")))
    first = F.col("s1") <= F.col("s2")
    long = long.select(
        "lang", F.concat_ws(" ", "x_word", "y_word", "z_word").alias("phrase"), "a",
        F.when(first, F.col("x")).otherwise(F.col("xy")).alias("l"), F.when(first, F.col("yz")).otherwise(F.col("z")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = short.unionByName(long).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    n = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
