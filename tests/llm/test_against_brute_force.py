"""Each operator on a whole small table against a plain version of the same contract."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from feedloom.llm import jobs, mixing, near_copies, neighbours, packing, quality, repeats, secret_scan, sharding, token_files, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(real):
    return {r["doc_id"]: r["text"] for r in real.select("doc_id", "text").collect()}


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality(real, texts):
    got = rows_of(jobs.QUERIES["op1_quality_rules"](real.sparkSession, "/root/testdata/sf0.001"))
    group, values = defaultdict(list), {}
    place = {r["doc_id"]: (r["lang"], r["source"]) for r in real.select("doc_id", "lang", "source").collect()}
    for i, t in texts.items():
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        n = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(5)}
        want = (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        values[i] = {
            "symbol_ratio": want[2] / max(want[1], 1), "upper_ratio": sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in t) / max(want[1], 1),
            "copied_lines": want[3] / max(len(lines), 1), "word_length": want[1] / max(want[0], 1),
            "longest_word": float(max((len(w.encode()) for w in words), default=0)),
        }
        if not r["base_failed"]:
            group[place[i]].append(i)
    every = [i for ids in group.values() for i in ids]
    for i, (lang, source) in place.items():
        near = group[(lang, source)]
        if len(near) < quality.MIN_ROWS:
            near = [j for (a, _), ids in group.items() if a == lang for j in ids]
        if len(near) < quality.MIN_ROWS:
            near = every
        ok = not got[i]["base_failed"]
        for c, f in quality.FENCES.items():
            v = sorted(values[j][c] for j in near)
            low, high = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]  # exact quantiles: the sketch holds all
            span = (high - low) * f.reach + f.slack
            assert got[i][c] == values[i][c]
            ok &= values[i][c] <= high + span and (not f.below or values[i][c] >= low - span)
        assert got[i]["kept"] == ok


def test_near_copies(real, texts):
    got = rows_of(near_copies.near_duplicates(real))
    prints = {}
    for i, t in texts.items():
        words = WORD.findall("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i]["fingerprint"] == f"{prints[i]:016x}"
    ids = sorted(prints)
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    assert {i: got[i]["component_id"] for i in ids} == {i: top(i) for i in ids}


def test_near_copies_in_crowded_buckets(spark):
    """Buckets over the limit are dealt again and lose no link."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 12)
    codes = {int(b) ^ (1 << int(x)) ^ (1 << int(y)) for b in base for x, y in rng.integers(0, 62, (40, 2))}
    df = spark.createDataFrame([(c,) for c in codes], "code long")
    for big in (20_000, 3):
        e = near_copies.links(df, 2, big)
        got = {r["node"]: r["root"] for r in near_copies.components(e).collect()}
        x = np.array(sorted(codes), dtype=np.int64)
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
        root = np.arange(len(x))
        for _ in range(len(x)):
            new = np.where(near, root[None, :], len(x)).min(1)
            if (new == root).all():
                break
            root = new
        assert all(got.get(int(a), int(a)) == int(x[r]) for a, r in zip(x, root))


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16)).astype(np.float32).astype(float)
    x[100:160] = x[100]  # copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(900, None, 0), (920, [0.0] * 16, 0), (940, [float("nan")] * 16, 0), (960, [None] * 16, 0), (980, [1.0], 0), (None, x[0].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    assert set(got) == set(range(0, 700, 20))
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(700), -s))[:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(c - s[v]) < 1e-12 for _, v, c in found)
        assert [(-c, v) for _, v, c in found] == sorted((-c, v) for _, v, c in found)
        hits += len({v for _, v, _ in found} & set(want.tolist()))
    assert hits >= 0.9 * 20 * len(got)
    few = df.filter("vec_id < 3 or vec_id = 920")
    assert sorted((r["query_id"], r["vec_id"]) for r in neighbours.nearest(few, F.lit(True)).collect()) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


@pytest.mark.parametrize("big", [20_000, 1])
def test_repeats(spark, real, big):
    some = [r["text"] or "" for r in real.select("text").limit(60).collect()]
    rows = list(enumerate(some + [some[0], "z" * 900, some[1][:700] + " tail", "é" * 450, None, some[2][300:] + some[3][:500]]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in repeats.remove_repeats(df, big=big).collect()}
    raw = {i: (t or "").encode() for i, t in rows}
    n = Counter(b[p : p + 400] for b in raw.values() for p in range(len(b) - 399))
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if n[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(b), int(gone.sum()), spans)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest() and bytes(r["kept"]) == kept


def library_ids(name, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = library_ids.__dict__.setdefault(name, Tokenizer.from_file(public_tokenizers.path(name)))
    lib.encode_special_tokens = True
    return np.array(lib.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


def test_token_files(real, texts):
    got, at = rows_of(token_files.round_trip(real)), 0
    for i in sorted(texts):
        ids = library_ids("byte_bpe_50k.json", texts[i])
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_name_a_damaged_block(spark, real, tmp_path):
    token_files.write(real, str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a")).withColumn("blocks", F.transform("blocks", lambda b: b.withField("crc32", b["crc32"] + 1)))
    bad.write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="damaged"):
        token_files.read(spark, str(tmp_path / "b")).collect()


def test_sharding(real, texts):
    got = rows_of(sharding.shard(real))
    size, slots = Counter(), defaultdict(list)
    for i, t in texts.items():
        raw = (t or "").encode()
        assert (got[i]["size"], got[i]["text_crc32"], got[i]["law"], got[i]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        size[got[i]["shard"]] += len(raw) + 1
        slots[got[i]["shard"]].append(got[i]["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) == set(range(8))
    mean, largest = sum(size.values()) / 8, max(len((t or "").encode()) for t in texts.values()) + 1
    assert max(size.values()) <= mean * (1 + sharding.EPS) + largest + 1


def test_sharding_moves_little(spark):
    """With one more shard, what stays under the bound moves only to the new one or by overflow."""
    cells = spark.range(1 << 16).select(F.col("id").cast("int").alias("cell"), F.lit(10).alias("size"), F.lit(1).alias("n"))
    a, b = sharding.place(cells, 8, 0.25), sharding.place(cells, 9, 0.25)
    moved = a.alias("a").join(b.alias("b"), "cell").filter("a.shard <> b.shard")
    assert moved.count() < 0.3 * (1 << 16)
    assert moved.filter("b.shard = 8").count() > 0


def test_secrets(real, texts):
    rules = [("assign", secret_scan.RULES[0].pattern, 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    got = rows_of(secret_scan.report(real))
    for i, t in texts.items():
        spans = sorted((m.start(), k, n, m.end()) for k, (n, p, g, least) in enumerate(rules) for m in re.finditer(p, t or "") if len(m[g]) >= least)
        text = ",".join(f"{n}:{a}:{z}" for a, _, n, z in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [got[i][f"n_{n}"] for n, *_ in rules] == [sum(s[2] == n for s in spans) for n, *_ in rules]


def test_packing(real, texts):
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in packing.pack(real).collect():
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for i, t in texts.items():
        ids, at = library_ids("word_bpe_49k.json", t), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            x = ids[r["start"] : r["start"] + r["length"]]
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(x.tobytes()))
            at += r["length"]
        assert at == len(ids)
    used = 0
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
        used += at
    assert used >= 0.9 * 4096 * (len(seqs) - 4)


def test_sum_of_squares_takes_the_cheapest_level():
    rng = np.random.default_rng(1)
    p = packing.SumOfSquares(16)
    for length in rng.integers(1, 16, 300).tolist():
        before = p.count.copy()
        price = {}
        for h in range(0, 17 - length):
            if h and not before[h]:
                continue
            c = before.copy()
            c[h] -= h > 0
            c[h + length] += h + length < 16
            price[h] = int((c**2).sum())
        p.put(length, None)
        assert int((p.count**2).sum()) == min(price.values())


def test_mixing_takes_the_budget(real):
    rows = mixing.select(real).collect()
    leaf = defaultdict(list)
    for r in rows:
        leaf[(r["domain"], r["lang"], r["source"])].append(r)
    for rs in leaf.values():
        took, longest = sum(r["copies"] * r["tokens"] for r in rs), max(r["tokens"] for r in rs)
        assert abs(took - rs[0]["budget"]) <= longest / 2 + 1
        assert {r["copies"] for r in rs} <= set(range(mixing.EPOCHS + 1))
    total = sum(r["tokens"] for r in rows)
    assert abs(sum(rs[0]["budget"] for rs in leaf.values()) - mixing.SHARE * total) <= len(leaf) + 8


def test_toxicity(spark, real):
    toxic = "you worthless moron what a pathetic loser".split()
    rng = np.random.default_rng(2)
    vocab = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choice(vocab, 60).tolist()
        y = int(i % 4 == 0)
        if y:
            for k in rng.integers(0, 60, 5):
                words[k] = toxic[1 + int(rng.integers(0, 6)) % 6]
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = rows_of(toxicity.score(docs, chain))
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i, _ in rows)
    assert np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.95
    spans = [tuple(map(int, s.split(":"))) for s in got[0]["spans"].split(",")]
    assert all(set(rows[0][1][a:z].split()) <= set(toxic) for a, z in spans)


def test_forward_backward():
    from feedloom.llm.chain import forward_backward

    rng = np.random.default_rng(4)
    step = np.array([[0.9, 0.1], [0.3, 0.7]])
    seqs = [np.exp(rng.normal(size=n)) for n in (5, 1, 0, 3)]
    for e, p in zip(seqs, forward_backward(seqs, step)):
        n = len(e)
        weight = {s: np.prod([e[i] if s >> i & 1 else 1 for i in range(n)]) * np.prod([step[s >> i & 1, s >> i + 1 & 1] for i in range(n - 1)]) for s in range(1 << n)}
        z = sum(weight.values())
        assert np.allclose(p, [sum(w for s, w in weight.items() if s >> i & 1) / z for i in range(n)])
