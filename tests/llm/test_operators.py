"""The operators against brute force, round trips and held-out accuracy, on small tables with every odd case."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import jaccard, langid, licenses, mixing, packing, pivots, rabitq, rans, sharding, tokens, warc

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kind string"


def odd_docs(spark, rows=None):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns whose names clash with the operators' own."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = rows or [(1, "one two three four"), (2, None), (3, ""), (4, "  \t\n "), (5, long), (6, "one two three four"), (6, "one two three four"), (7, "ONE two, three <|endoftext|> ½ 漢字 x\x1cy"), (8, "a"), (9, long + " tail")]
    df = spark.createDataFrame([(k, t, "en" if (k or 0) % 2 else None, None if k == 3 else f"s{(k or 0) % 2}", 0, "x") for k, t in rows], SCHEMA)
    return df.withColumns({"start": F.lit(1), "score": F.lit("c"), "label": F.lit(0)})


def empty(spark):
    return odd_docs(spark).limit(0)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aB é'st½3 \n\t\xa0\x1c.—漢!_"), max_size=40))
def test_encoder_equals_the_library(text):
    for path in (BYTES, WORDS):
        e = tokens.encoder(path)
        assert e.kind and e.ids(text).tolist() == ids_of(path, text)


def test_encoder_equals_the_library_on_every_plain_character():
    """Capitals whose small letters lie beyond the fixed classes (Ɓ, Ə, Ʒ, Ⱥ ...) among them."""
    for path in (BYTES, WORDS):
        e = tokens.encoder(path)
        assert e.kind
        for c in map(chr, [*range(1, 0x250), *range(0x2010, 0x2028)]):
            for text in (f"{c}aya", f"a{c}b", f"x {c}. {c}{c}"):
                assert e.ids(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, text
        assert e.ids("plain text").tolist() == ids_of(path, "plain text")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_encoder_equals_the_library_on_every_document(sf):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column(0).to_pylist()
    for path in (BYTES, WORDS):
        e = tokens.Encoder(path)
        want = e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert all(e.ids(t).tolist() == w.ids for t, w in zip(texts, want, strict=True))


def check_pieces(rows, docs, capacity):
    """Every id of every row lies in one piece, and sequences are gapless."""
    want = collections.Counter((k, zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in docs)
    cut, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        cut[r.doc_id, r.start].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= capacity
    got = collections.Counter()
    for (k, start), rs in list(cut.items()):
        if start == 0:
            for r in rs:
                ids, n = bytes(r.ids_le), r.length
                while n < r.doc_tokens:
                    nxt = next(x for x in cut[k, n] if x.doc_tokens == r.doc_tokens)
                    ids, n = ids + bytes(nxt.ids_le), n + nxt.length
                got[k, zlib.crc32(ids)] += 1
    assert got == want
    return sum(capacity - sum(n for _, n in p) for p in sequences.values())


def test_packing(spark):
    df = odd_docs(spark)
    rows = packing.pack_documents(df, BYTES, capacity=64).collect()
    padding = check_pieces(rows, [(r.doc_id, [*ids_of(BYTES, r.text), 0]) for r in df.collect()], 64)
    assert padding < 64 * df.rdd.getNumPartitions()
    assert packing.pack_documents(empty(spark), BYTES).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60), st.integers(8, 70))
def test_pack_covers_and_fills(lengths, capacity):
    got = packing.pack(lengths, capacity)
    for d, n in enumerate(lengths):
        at = 0
        for _, start, size, *_ in sorted(p for p in got if p[0] == d):
            assert start == at and size > 0
            at += size
        assert at == n
    by = collections.defaultdict(list)
    for _, _, n, q, o in got:
        by[q].append((o, n))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
    assert sum(sum(n for _, n in p) < capacity for p in by.values()) <= 1 and set(by) == set(range(len(by)))


def test_pack_takes_the_cheapest_sequence_with_room():
    """In windows of many sequences too: a piece is cut only where no sequence has room for all of it."""
    r = np.random.default_rng(3)
    for many, capacity, linear, quadratic in ((2500, 1024, 1.0, 0.01), (3000, 256, 0.0, 0.01), (400, 64, 1.0, 0.0), (50, 1024, 1.0, 0.01)):
        lengths = np.maximum(1, r.lognormal(5.0, 1.2, many)).astype(int).tolist()
        sequence = sum(n // capacity for n in lengths)
        total = sum(n % capacity for n in lengths)
        bins = -(-total // capacity)
        room, cost = np.full(bins, capacity), np.zeros(bins)
        if total % capacity:
            room[-1] = total % capacity
        want = []
        for n, d in sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity), key=lambda x: (-x[0], x[1])):
            start = lengths[d] - n
            while n:
                can = np.flatnonzero(room >= n) if start == lengths[d] // capacity * capacity else np.zeros(0, int)
                can = can if len(can) else np.flatnonzero(room > 0)
                b = can[np.argmin(cost[can])]
                part = int(min(n, room[b]))
                want.append((d, start, part, sequence + int(b)))
                room[b] -= part
                cost[b] += linear * part + quadratic * part * part
                n, start = n - part, start + part
        got = [x[:4] for x in packing.pack(lengths, capacity, linear, quadratic) if x[2] < capacity]
        assert sorted(got) == sorted(want)


def brute_components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_rabitq(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((12, 16))
    rows = []
    for i in range(240):
        v = base[i % 12] + r.standard_normal(16) * (0.01 + 0.3 * (i % 5 == 0))
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 12 % 3))
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(30)] + [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("nan")] * 16, 0), (403, [None] * 16, 0), (404, rows[0][1], None), (405, [1.0, 2.0], 0), (406, [], 0), (407, rows[0][1], 99), (None, rows[0][1], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "vec_id long, embedding array<float>, label int, n_links string")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in rabitq.near_duplicates(df, block=16).collect()}
    fine = {k: (np.array(v, np.float64), c) for k, v, c in rows if k is not None and v and c is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in fine for b in fine if a < b and fine[a][1] == fine[b][1] and len(fine[a][0]) == len(fine[b][0]) and fine[a][0] @ fine[b][0] / np.linalg.norm(fine[a][0]) / np.linalg.norm(fine[b][0]) >= 0.98]
    n = collections.Counter(x for p in links for x in p)
    comp = brute_components([k for k, *_ in rows], links)
    assert len(links) > 500
    assert got == {k: (n[k], comp[k], k is not None and comp[k] == k) for k, *_ in rows}
    assert rabitq.near_duplicates(df.limit(0)).count() == 0


def planted(rows, dim=64, labels=10, seed=2):
    """Vectors without near copies, and copies at cosines from 0.98 to 0.999 in pairs and in one group of hundreds."""
    r = np.random.default_rng(seed)
    v = r.standard_normal((rows, dim))
    label = r.integers(0, labels, rows)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    v = unit(v)
    for i in range(0, rows // 3, 2):
        c = r.uniform(0.98, 0.999)
        other = v[i + 1] - (v[i + 1] @ v[i]) * v[i]
        v[i + 1], label[i + 1] = c * v[i] + math.sqrt(1 - c * c) * unit(other), label[i]
    big = slice(rows // 2, rows // 2 + min(rows // 20, 700))
    v[big] = unit(v[big.start] + 0.009 * r.standard_normal(v[big].shape))
    label[big] = 0
    return v.astype(np.float32), label


def brute_links(v, label, threshold=0.98):
    x = v.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for c in np.unique(label):
        at = np.flatnonzero(label == c)
        i, j = np.nonzero(np.triu(x[at] @ x[at].T >= threshold, 1))
        out += zip(at[i].tolist(), at[j].tolist(), strict=True)
    return out


def test_rabitq_finds_planted_copies(spark):
    v, label = planted(6000)
    links = brute_links(v, label)
    df = spark.createDataFrame([(i, x, int(c)) for i, (x, c) in enumerate(zip(v.tolist(), label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {x.vec_id: (x.n_links, x.component_id) for x in rabitq.near_duplicates(df, block=200).collect()}
    n, comp = collections.Counter(x for p in links for x in p), brute_components(range(len(v)), links)
    found = sum(k for k, _ in got.values()) // 2
    print(f"links found {found} of {len(links)}")
    assert len(links) > 20_000 and found >= 0.999 * len(links)
    assert sum(got[k] == (n[k], comp[k]) for k in got) >= 0.999 * len(got)


def test_rabitq_pairs_of_groups():
    sizes = np.array([3, 1, 4, 2])
    got = sorted((int(a), int(b)) for x, y in rabitq.within(sizes) for a, b in zip(x, y, strict=True))
    assert got == [(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7), (8, 9)]
    r = np.random.default_rng(0)
    v, label = planted(400, 32, 1)
    turn = rabitq.rotation(32, 256)
    signs, factor = rabitq.codes(v / np.linalg.norm(v, axis=1, keepdims=True), turn)
    words = np.packbits(signs, axis=1, bitorder="little").view("<u8")
    none, one = np.zeros(400, np.int64), np.array([400])
    want = set(brute_links(v, label))
    for few in (8, 1000):  # by products of matrices, and by lists of pairs
        x, y = rabitq.linked(v.astype(np.float64), signs, words, factor, none, none, one, turn, 8, 0.98, few)
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == want
    side = r.integers(1, 3, 400)
    x, y = rabitq.linked(v.astype(np.float64), signs, words, factor, none, side, one, turn, 8, 0.98)
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == {(a, b) for a, b in want if side[a] != side[b]}


def test_rabitq_bounds_hold():
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rabitq.rotation(32, 256)
    assert np.allclose(turn @ turn.T, np.eye(32))
    signs, factor = rabitq.codes(x, turn)
    assert (rabitq.upper_bounds(signs, factor, x @ turn) >= x @ x.T - 1e-6).all()
    estimate = rabitq.upper_bounds(signs, factor, x @ turn, 0.0)
    assert abs((estimate - x @ x.T).mean()) < 0.002


def mixed(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "big" if i % 3 else f"s{i % 5}") for i in range(600)] + [(900, None, "none"), (901, "", "none"), (902, "x y", None), (902, "x y", None), (None, "z", "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("epoch", F.lit("clash"))


def test_mixing(spark):
    df = mixed(spark)
    out = mixing.mix(df, mixing.word_count(F.col("text")), target_entropy=1.0, max_repeat=2.0, block_rows=20, prefix="m_").toPandas()
    assert set(df.columns) <= set(out.columns)
    plain = df.withColumn("n", mixing.word_count(F.col("text"))).toPandas()
    total = {k: g.n.sum() for k, g in plain.groupby("source", dropna=False)}
    used = {k: (g.m_n_tokens.sum(), len(g[g.m_epoch == 0])) for k, g in out.groupby("source", dropna=False)}
    key = lambda k: None if k != k else k
    total, used = {key(k): v for k, v in total.items()}, {key(k): v for k, v in used.items()}
    for k, n in total.items():
        assert used[k][1] == (plain.source.isna() if k is None else plain.source == k).sum(), "every document is drawn once"
        if n:
            assert n <= used[k][0] <= 2 * n + 7
    assert out.groupby(["source", "doc_id", "m_epoch"], dropna=False).size().max() == 2  # the repeated row
    repeats = {k: used[k][0] / n for k, n in total.items() if n}
    assert repeats["big"] == 1.0 and max(repeats.values()) > 1.5
    assert mixing.mix(df.limit(0), mixing.word_count(F.col("text"))).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    """Names that the operator uses itself change neither rows nor values."""
    df = mixed(spark).select("doc_id", "text", "source")
    names = ["_tokens", "_block", "_blocks", "_source", "_s", "_b", "_epoch", "_rank", "_weight", "_take", "_before", "c0", "c1", "tokens", "in_block", "Weight"]
    mix = lambda x: mixing.mix(x, mixing.word_count(F.col("text")), target_entropy=1.0, max_repeat=2.0, block_rows=20)
    got, want = mix(df.withColumns({n: F.lit(n) for n in names})), mix(df)
    assert [c for c in got.columns if c not in want.columns] == names[:-1] and got.columns.count("weight") == 1
    assert all(r[n] == n for r in got.collect() for n in names[:-1])
    key = lambda x: collections.Counter(map(tuple, x.select(want.columns).collect()))
    assert key(got) == key(want)


def test_mixing_orders_blocks_in_runs(spark, monkeypatch):
    """Runs of a few blocks give the order and the cut of one run over all; rows without a doc_id are dealt by their texts."""
    df = mixed(spark).select("doc_id", "text", "source").unionByName(spark.createDataFrame([(None, f"x{i} y z", "s1") for i in range(200)], "doc_id long, text string, source string"))
    mix = lambda: mixing.mix(df, mixing.word_count(F.col("text")), target_entropy=1.0, max_repeat=2.0, block_rows=5, key=mixing.text_key())
    whole = mix().toPandas()
    monkeypatch.setattr(mixing, "RUN", 4)
    rows = lambda x: collections.Counter(map(str, x.itertuples(index=False)))
    assert rows(mix().toPandas()) == rows(whole)
    assert whole.groupby(["source", "epoch"], dropna=False).block_rank.agg(lambda r: set(r) == set(range(r.max() + 1))).all()
    assert whole[whole.doc_id.isna()].block.nunique() > 20


def test_mixing_exponent(spark):
    sizes = spark.createDataFrame([("a", 5, 800), ("b", 5, 100), ("c", 5, 100)], "source string, docs long, tokens long")
    x = mixing.exponent(sizes, 0.9, None)
    w = np.array([0.8, 0.1, 0.1]) ** x
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9 * math.log(3), abs=1e-4)
    y = mixing.exponent(sizes, None, 1.5)
    assert (0.1**y / 0.1) / (0.8**y / 0.8) == pytest.approx(1.5, abs=1e-4)
    got = {r.source: r.budget for r in mixing.budgets(sizes, x, 500).collect()}
    assert sum(got.values()) == pytest.approx(500, abs=2)


def brute_jaccard(rows, n, percent):
    sets = {}
    for k, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.setdefault(k, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else sets.setdefault(k, {tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = brute_components(ids, links)
    return {k: (len(sets[k]), comp[k]) for k in ids}, len(links)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard(spark, n, percent):
    r = random.Random(n)
    vocab = [f"v{i}" for i in range(300)]
    rows = []
    for g in range(40):
        size = r.choice([3, 6, 12, 25, 40, 90, 200])
        text = r.choices(vocab, k=size)
        for _ in range(6):
            copy = list(text)
            for _ in range(r.randrange(0, max(2, size // 12))):
                copy[r.randrange(size)] = r.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    passage = " ".join(r.choices(vocab, k=60))
    rows += [(1000 + i, passage + " " + " ".join(r.choices(vocab, k=20))) for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "solo"), (2004, "SOLO"), (2005, "a\x1cb")]
    df = odd_docs(spark, rows)
    want, links = brute_jaccard(rows, n, percent)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.components(df, n, percent, block=8).collect()}
    assert links > 60 and got == want
    kept = {x.doc_id for x in jaccard.keep_first(df, n, percent).collect()}
    assert kept == {k for k, (_, c) in want.items() if c == k}


def test_jaccard_odd_tables(spark):
    df = odd_docs(spark)
    got = {(x.doc_id, x.component_id) for x in jaccard.components(df, 3, 90).collect()}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 1), (9, 5)} <= got
    kept = jaccard.keep_first(df, 3, 90)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [1, 2, 3, 4, 5, 7, 8]
    assert jaccard.components(empty(spark)).count() == 0


def test_jaccard_index_never_misses():
    """Deletion neighbourhoods and segment subsets both find pairs at the limit, over sizes of every band."""
    r = np.random.default_rng(0)
    for percent in (80, 90):
        for force in (False, True):
            bands = jaccard.allocate(1000, percent)
            if force:
                bands = [jaccard.Band(b.lo, b.hi, jaccard.differ(b.hi - 1, percent) // 2 + 1, True) for b in bands]
            for size in [*range(4, 60), 100, 333, 700]:
                x = r.integers(0, 1 << 62, size).astype(np.uint64)
                for grow in (0.0, 0.5, 1.0):
                    y = x
                    while True:  # as different as the threshold allows
                        z = np.append(y, r.integers(0, 1 << 62, 1).astype(np.uint64)) if r.random() < grow else y[1:]
                        met = len(np.intersect1d(x, z))
                        if not len(z) or 100 * met < percent * (len(x) + len(z) - met):
                            break
                        y = z
                    if len(y) == len(x):
                        continue
                    doc = np.repeat([0, 1], [len(x), len(y)])
                    d, k = jaccard.index_keys(doc, np.concatenate([np.sort(x), np.sort(y)]), 2, bands, percent)
                    assert set(k[d == 0].tolist()) & set(k[d == 1].tolist()), (percent, force, size, grow)


def test_langid(spark):
    r = random.Random(2)
    syllables = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["sch", "ung", "ei", "der"], "cc": ["ção", "ent", "os", "que"]}
    rows = [(i, " ".join("".join(r.choices(syllables[c], k=r.randrange(1, 4))) for _ in range(r.randrange(3, 60))), c) for i in range(300) for c in [r.choice(list(syllables))]]
    df = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !?", "cc"), (1003, "漢字", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    got = {x.doc_id: x for x in langid.identify(df).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got) and len(got) == 304
    held = [(got[k].lang_pred, c) for k, _, c in rows if got[k].held_out]
    assert len(held) > 60 and sum(a == b for a, b in held) / len(held) > 0.97
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert all(0 <= x.score <= 1 for x in got.values()) and got[1003].lang_pred in syllables
    assert {x.lang_pred for x in langid.predict(df, {}).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0


def test_langid_learns_from_distinct_texts(spark):
    """Copies neither cost a language its prototype nor fill its sample."""
    few = [f"moi {w} talo" for w in ("kissa", "koira", "lintu")]
    many = [f"the {chr(97 + i % 26)}{chr(97 + i // 26)} house" for i in range(500)]
    rows = [("fi", few[i % 3]) for i in range(9000)] + [("en", t) for t in many] + [("en", many[i % 2]) for i in range(3000)]
    rows += [("de", None)] * 50 + [("de", "12 34")] * 50 + [("de", f"{i}") for i in range(400)] + [("de", "das haus")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = langid.train(df, F.lit(True), per_lang=100)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    want = {"fi": few, "en": sorted(many, key=hashes.get)[:100], "de": ["das haus"]}
    assert set(got) == set(want)
    for k, texts in want.items():
        assert np.allclose(got[k], langid.Bundler().bundle(texts).sum(axis=0, dtype=np.float64), atol=1e-4)


def test_langid_bundles_as_defined():
    b = langid.Bundler(128, 3)
    v = lambda c: langid.vectors(np.array([ord(c)]), 128)[0].astype(int) if c != " " else langid.vectors(np.array([0]), 128)[0].astype(int)
    want = sum(np.roll(v(x), 2) * np.roll(v(y), 1) * v(z) for x, y, z in (" ab", "ab ", "b c", " ca", "ca "))
    got = b.bundle(["Ab, 12\tCA", None])
    assert np.allclose(got[0], want / np.linalg.norm(want), atol=1e-6) and not got[1].any()


def test_pivots(spark):
    r = np.random.default_rng(7)
    rows = [(i, [float(x) for x in r.standard_normal(8).astype(np.float32)]) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(40)] + [(600, None), (700, [None] * 8), (800, [float("inf")] * 8), (900, [1.0, 2.0]), (1000, []), (1100, [0.0] * 8)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, rank int")
    v = pivots.integers(df)
    got = collections.defaultdict(list)
    for x in pivots.top_k(v.filter("key % 100 = 0"), v, candidate_rows=64, query_rows=3).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    whole = {k: [math.floor(1024 * float(np.float32(c))) for c in e] for k, e in rows if e and None not in e and np.isfinite(e).all()}
    want = {}
    for q in (k for k in whole if k % 100 == 0):
        s = sorted((-sum(a * b for a, b in zip(whole[q], e, strict=True)), k) for k, e in whole.items() if k != q and len(e) == len(whole[q]))
        if s:
            want[q] = [(i + 1, k, -x) for i, (x, k) in enumerate(s[:10])]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert pivots.top_k(v.limit(0), v).count() == 0 and pivots.top_k(v, v.limit(0)).count() == 0


def test_pivots_share_evaluated():
    """Floors and tables change the candidates that are computed, never the result; prints the share computed."""
    r = np.random.default_rng(3)
    middles = r.standard_normal((20, 16)) * 3000
    near = np.floor(middles[r.integers(0, 20, 3000)] + r.standard_normal((3000, 16)) * 60)
    near = np.floor(near / np.linalg.norm(near, axis=1, keepdims=True) * 10000)
    for name, c in (("clusters", near), ("independent", np.floor(r.standard_normal((3000, 64)) * 128))):
        ids, picked = np.arange(len(c)), np.arange(0, len(c), 100)
        pivots_ = pivots.pick_pivots(c[:500], 32)
        exact = c[picked] @ c.T
        shares = {}
        for tag, floors in (("alone", None), ("with floors", np.sort(np.where(picked[:, None] == ids[None, :500], -np.inf, exact[:, :500]), axis=1)[:, -10])):
            computed: list[int] = []
            for i, (q, js, scores) in enumerate(pivots.search_block(picked, c[picked], ids, c, pivots_, 10, floors=floors, evaluated=computed)):
                want = sorted((-int(x), j) for j, x in enumerate(exact[i].tolist()) if j != q)[:10]
                assert q == picked[i] and [(-s, j) for s, j in zip(scores, js.tolist(), strict=True)] == want
            shares[tag] = sum(computed) / exact.size
        print(f"pivots, {name}: share of candidates computed {shares}")
        assert name == "independent" or max(shares.values()) < 0.25


def test_pivots_rules_out_blocks():
    """A block whose range of distances cannot reach a query's floor is not computed; ties with the floor are."""
    c = np.array([[100.0, 0.0], [100.0, 1.0], [99.0, 0.0]])
    far = np.array([[-100.0, 0.0], [-100.0, 1.0]])
    computed: list[int] = []
    q, at = np.array([[100.0, 0.0]]), c[:1]
    assert [x[2] for x in pivots.search_block(np.array([9]), q, np.arange(2), far, at, 2, floors=np.array([9900.0]), evaluated=computed)] == [[]] and computed == [0]
    (_, js, scores), = pivots.search_block(np.array([9]), q, np.arange(3), c, at, 3, floors=np.array([10000.0]))
    assert js.tolist() == [0, 1] and scores == [10000, 10000]
    assert pivots.raised(-np.inf, [5, 4], 2) == 4 and pivots.raised(7.0, [5, 4], 2) == 7 and pivots.raised(1.0, [5], 2) == 1
    assert pivots.raised(-np.inf, [pivots.LONG[0]] * 2, 2) == -np.inf


def test_pivots_odd_rows(spark):
    """Rows with a null key take no part; repeated keys are vectors of their own and never their own results."""
    rows = [(None, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [0.25, 0.0]), (1, [0.25, 0.0]), (2, [1.0, 2.0, 3.0]), (100, [1.0, 0.0])]
    v = pivots.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = collections.Counter((r.query_id, r.vec_id, r.score) for r in pivots.top_k(v.filter("key = 100"), v).collect())
    assert got == {(100, 0, 1 << 20): 1, (100, 0, 1 << 19): 1, (100, 1, 1 << 18): 2}


def test_pivots_large_numbers():
    c = np.array([[2.0**40, 1.0], [2.0**40, 2.0], [-(2.0**40), 0.0]])
    got = list(pivots.search_block(np.array([9]), np.array([[2.0**20, 3.0]]), np.arange(3), c, c[:1], 2))
    assert got[0][1].tolist() == [1, 0] and got[0][2] == [2**60 + 6, 2**60 + 3]


def test_warc(spark, tmp_path):
    rows = [(5, "http://a/1", "<p>same</p>"), (2, "http://a/ 2", "<p>same</p>"), (9, None, None), (7, "u", ""), (3, "v", "é" * 5000), (3, "v", "é" * 5000), (11, "w", "other\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, payload_bytes int")
    folder = f"file://{tmp_path}/a"
    manifest = warc.write_warc(df, folder, roll_bytes=200)
    assert manifest.count() > 2
    got = sorted((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to or -1) for x in warc.read_warc(spark, folder).collect())
    first, want, seen = {}, [], set()
    for k, _, h in rows:
        b = (h or "").encode()
        first[b] = min(first.get(b, k), k)
    for k, _, h in rows:
        b = (h or "").encode()
        response = first[b] == k and (k, b) not in seen
        seen.add((k, b))
        want.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", -1 if response else first[b]))
    assert got == sorted(want)
    again = warc.write_warc(df, f"file://{tmp_path}/b", roll_bytes=200)
    assert sorted(r.sha1 for r in again.collect()) == sorted(r.sha1 for r in manifest.collect())
    names = {p.name for p in (tmp_path / "a").iterdir()}
    assert {r.file for r in manifest.collect()} == {n for n in names if n.endswith(".gz")} and not any(n.startswith(".tmp") for n in names)
    one = next(warc.parse((tmp_path / "a" / manifest.first().file).read_bytes()))[0]
    assert one["WARC-Block-Digest"].startswith("sha1:") and one["WARC-Date"] == "2000-01-01T00:00:00Z"
    assert warc.archive(df.limit(0)).count() == 0


def test_warc_null_page_ids_and_manifest(spark, tmp_path):
    rows = [(None, "u", "same"), (-1, "u", "other"), (4, "u", "same"), (7, "u", "same"), (None, "u", "lone"), (None, "v", "lone")]
    folder = f"file://{tmp_path}/a"
    m = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = sorted((str(x.page_id), x.payload_bytes, x.record_type, x.refers_to or 0) for x in warc.read_warc(spark, folder, m).collect())
    assert got == sorted([("None", 4, "revisit", 4), ("-1", 5, "response", 0), ("4", 4, "response", 0), ("7", 4, "revisit", 4), ("None", 4, "response", 0), ("None", 4, "response", 0)])
    name = tmp_path / "a" / m.first().file
    name.write_bytes(name.read_bytes() + b"\0")
    with pytest.raises(Exception, match="manifest|header"):
        warc.read_warc(spark, folder).count()


def test_warc_small_payloads_stay_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "x"), (2, "u", "x"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    m = warc.write_warc(df, f"file://{tmp_path}/a", min_revisit_bytes=5)
    assert {x.page_id: x.record_type for x in warc.read_warc(spark, f"file://{tmp_path}/a", m).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_sharding(spark):
    df = odd_docs(spark).unionByName(odd_docs(spark, [(100 + i, f"t{i}") for i in range(3000)]))
    rows = sharding.shard_documents(df).collect()
    assert len(rows) == df.count()
    by = collections.defaultdict(list)
    for x in rows:
        by[x.shard].append(x.slot)
        assert x.grown_shard in (x.shard, 24)
    assert set(by) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 2 * min(map(len, by.values()))
    moved = sum(x.grown_shard == 24 for x in rows)
    assert 0.02 < moved / len(rows) < 0.07
    texts = collections.Counter((x.doc_id, (x.text or "").encode()) for x in df.collect())
    assert collections.Counter((x.doc_id, x.size, x.text_crc32) for x in rows) == collections.Counter({(k, len(t) + 8, zlib.crc32(t)): n for (k, t), n in texts.items()})
    assert sharding.shard_documents(empty(spark)).count() == 0


def test_sharding_descends_as_defined(spark):
    """Every row's path, drawn level by level in Python from the same hashes."""
    tree = sharding.topology(25, planned=24)
    names = []
    stack = [tree]
    while stack:
        n = stack.pop()
        names += [c.name for c in n.children]
        stack += n.children
    df = spark.range(200).withColumn("key", F.when(F.col("id") % 17 == 0, None).otherwise(F.col("id") - 50))
    hashes = df.select("id", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.xxhash64(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(n)) for n in names])).alias("h"))
    drawn = {r.id: r.h for r in hashes.collect()}

    def descend(h):
        at = tree
        while at.children:
            at = min(at.children, key=lambda c: -math.log((((h[c.name] & (2**64 - 1)) >> 11) + 1.0) / (2**53 + 1)) / c.weight)
        return at.shard

    got = {r.id: r.shard for r in sharding.place(df, "key", tree).collect()}
    assert got == {i: descend(h) for i, h in drawn.items()}


def test_sharding_moves_only_along_the_changed_path(spark):
    leaf = lambda s, w=1.0: sharding.Node(f"s{s}", shard=s, own_weight=w)
    tree = lambda w: sharding.Node("root", (sharding.Node("r0", (sharding.Node("k0", (leaf(0, w), leaf(1))), sharding.Node("k1", (leaf(2),)))), sharding.Node("r1", (sharding.Node("k2", (leaf(3), leaf(4, 0.0))),))))
    df = spark.range(4000)
    both = sharding.place(sharding.place(df, "id", tree(1.0), "a"), "id", tree(3.0), "b").groupBy("a", "b").count().collect()
    moves = {(r.a, r.b) for r in both if r.a != r.b}
    assert all(a == 3 or b == 0 or (a, b) == (2, 1) for a, b in moves), moves  # out of region r1, into rack k0, or into shard 0
    assert not any(r.b == 4 for r in both) and {r.a for r in both} == {0, 1, 2, 3}


def test_rans_archive(spark):
    df = odd_docs(spark).unionByName(odd_docs(spark, [(None, "no id"), (0, "first")]))
    got = sorted(((x.doc_id if x.doc_id is not None else -1, x.start, x.n_tokens, bytes(x.ids_le)) for x in rans.archive(df, WORDS).collect()), key=lambda x: x[1])
    want, at = [], 0
    docs = sorted(((-1 if x.doc_id is None else x.doc_id, np.array([*ids_of(WORDS, x.text), 2], "<u4").tobytes()) for x in df.collect()), key=lambda x: x[0])
    for k, ids in docs:
        want.append((k, at, len(ids) // 4, ids))
        at += len(ids) // 4
    assert got == want
    assert rans.archive(empty(spark), WORDS).count() == 0


def test_rans_parts_of_a_file_and_manifest(spark, tmp_path):
    df = odd_docs(spark, [(i, f"w{i} " * (i % 50) + "end") for i in range(300)])
    folder = f"file://{tmp_path}/a"
    manifest = rans.write_tokens(df, folder, WORDS, partitions=2)
    key = lambda rows: sorted((r.doc_id, r.start, bytes(r.ids_le)) for r in rows)
    whole = key(rans.read_tokens(spark, folder).collect())
    assert len(whole) == 300 and key(rans.read_tokens(spark, folder, task_ids=1000).collect()) == whole
    name = tmp_path / "a" / manifest.first().file
    data = bytearray(name.read_bytes())
    data[2] ^= 1
    name.write_bytes(bytes(data))
    with pytest.raises(Exception, match="match"):
        rans.read_tokens(spark, folder).count()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=400), st.integers(1, 40))
def test_rans_blocks(ids, lanes):
    table = rans.Table(dict(collections.Counter(ids) or {5: 1}))
    again = rans.Table.load(table.dump())
    block = table.encode(np.array(ids, np.int64), lanes)
    assert again.decode(block).tolist() == ids
    if ids:
        with pytest.raises(ValueError, match="checksum"):
            again.decode(block[:-1] + bytes([block[-1] ^ 1]))


def test_rans_random_access_and_size(tmp_path):
    r = np.random.default_rng(0)
    ids = np.minimum(500, r.pareto(1.0, 20_000) * 5).astype(np.int64)
    counts = np.bincount(ids)
    table = rans.Table({i: int(n) for i, n in enumerate(counts) if n})
    with open(tmp_path / "f", "wb") as f:
        w = rans.FileWriter(f, table, 1, 100, block_ids=1000)
        for i in range(0, 20_000, 777):
            w.add(i, ids[i : i + 777])
        docs, n, size, _ = w.close()
    import pyarrow.fs as pafs

    reader = rans.FileReader(pafs.LocalFileSystem().open_input_file(str(tmp_path / "f")), table, 1)
    assert reader.span(4321, 2500, 1000).tolist() == ids[4321:6821].tolist()
    assert [at for _, at, _ in reader.documents()] == list(range(100, 20_100, 777)) and n == 20_000
    got = [(k, x.tolist()) for a in range(0, 20_000, 1500) for k, _, x in reader.documents(a, a + 1500)]
    assert got == [(k, x.tolist()) for k, _, x in reader.documents()]
    p = counts[counts > 0] / 20_000
    assert size * 8 < 20_000 * -(p * np.log2(p)).sum() * 1.35


def test_licenses(spark):
    full = licenses.TEMPLATES["mit"][1]
    rows = [(1, "All RIGHTS, reserved; all rights reserved"), (2, None), (3, "under the General-Public (License) x cc_by"), (4, "z " * 20 + full.upper() + " end"), (5, "CC BY cc by"), (6, "permission is hereby granted, free of soup"), (7, full[:200] + " INSERTED words " + full[200:]), (8, "all rights reservedé"), (9, "Released under the MIT License.")]
    df = odd_docs(spark, rows)
    got = {x.doc_id: x for x in licenses.scan(df).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for k, text in rows:
        w = word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
        x = got[k]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({y for _, y in hits})))
        assert set(x.base_labels.split(",")) <= set(x.labels.split(",")) | {""} and 0 <= x.score <= 1
    assert got[4].labels == "mit" and got[4].score == 1.0 and got[4].spans[0]["first"] == 20
    assert got[7].labels == "mit" and got[9].labels == "mit" and got[6].labels == ""
    assert licenses.scan(empty(spark)).count() == 0


def test_licenses_of_one_word():
    """Phrases and templates of a single word hit wherever the word stands."""
    a = licenses.built({"zlib": ["zlib"], "two": ["alpha beta"]}, {"mit": "mit"})
    for text, base, spans in (("mit", [0], []), ("x mit y mit", [1, 3], []), ("zlib", [], [(0, 0)]), ("a zlib alpha beta", [], [(1, 1), (2, 3)]), ("alpha", [], [])):
        got = licenses.scan_words(licenses.words_of(text.encode()), a)
        assert [i for i, _ in got["base"]] == base and [(s["start"], s["end"]) for s in got["spans"]] == spans, text


def test_licenses_chain_again_after_a_span():
    a = licenses.built(licenses.TEMPLATES, licenses.BASE_PHRASES)
    spans = lambda text: [(s["start"], s["end"], s["label"]) for s in licenses.scan_words(licenses.words_of(text.encode()), a)["spans"]]
    one = "released under the mit license"
    assert spans(f"{one} {one}") == [(0, 4, "mit"), (5, 9, "mit")]
    assert spans(f"{one} {'x ' * 20}{one}") == [(0, 4, "mit"), (25, 29, "mit")]


def brute_spans(words, templates, min_match, max_gap, min_cover):
    """Best chains of maximal common runs, by trying every order of anchors (small inputs)."""
    out = []
    for label, texts in templates.items():
        for text in texts:
            t = text.split()
            # the longest run of any template that ends at a word, where it cannot grow
            ending = [max((n for x in sum(templates.values(), []) for e in range(len(x.split())) for n in range(1, min(e, i) + 2) if words[i - n + 1 : i + 1] == x.split()[e - n + 1 : e + 1]), default=0) for i in range(len(words))]
            anchors = []
            for i, n in enumerate(ending):
                grows = i + 1 < len(words) and ending[i + 1] == n + 1
                if n and not grows:
                    for e in range(len(t)):
                        run = min(n, e + 1)
                        if run >= min(min_match, len(t)) and words[i - run + 1 : i + 1] == t[e - run + 1 : e + 1] and (n <= e + 1 and words[i - n + 1 : i + 1] == t[e - n + 1 : e + 1]):
                            anchors.append((i, e, n))
            best = []
            for k, (i, e, n) in enumerate(anchors):
                here = (n, i - n + 1)
                for m, (j, f, _) in enumerate(anchors[:k]):
                    cut = max(0, j - (i - n), f - (e - n))
                    if cut < n and j < i and f < e and i - n + cut - j <= max_gap and e - n + cut - f <= max_gap and best[m][0] + n - cut > here[0]:
                        here = (best[m][0] + n - cut, best[m][1])
                best.append(here)
            taken = []
            for k in sorted(range(len(anchors)), key=lambda k: (-best[k][0], anchors[k][0])):
                s, e = best[k][1], anchors[k][0]
                if all(e < a or s > b for a, b in taken):
                    taken.append((s, e))
                    if best[k][0] >= min_cover * len(t):
                        out.append((s, e, label, best[k][0]))
    return sorted(set(out))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=6), min_size=1, max_size=3), st.lists(st.sampled_from("abcx"), max_size=14), st.integers(1, 3), st.integers(0, 2))
def test_license_spans_against_brute_force(templates, text, min_match, max_gap):
    texts = {f"l{i}": [" ".join(t)] for i, t in enumerate(templates)}
    a = licenses.TemplateAutomaton(texts, {"zz": "zz"})
    words = [w.encode() for w in text]
    got = licenses.scan_words(words, a, min_match, max_gap, 0.5)["spans"]
    want = brute_spans(text, texts, min_match, max_gap, 0.5)
    within = lambda s, o: o[0] <= s[0] and o[1] >= s[1] and o[3] > s[3] and o[2] != s[2]
    want = [s for s in want if not any(within(s, o) for o in want)]
    assert sorted({(s["start"], s["end"], s["label"], s["covered"]) for s in got}) == want


def test_license_templates_from_files(spark, tmp_path):
    (tmp_path / "own-1.0.txt").write_text("Every user may copy this text as often as wanted")
    got = licenses.read_templates(spark, str(tmp_path))
    assert list(got) == ["own-1.0"]
    found = licenses.scan(odd_docs(spark, [(1, "x every USER may copy this text, as often as wanted"), (None, "none")]), templates=got).collect()
    assert sorted((r.doc_id or 0, r.labels) for r in found) == [(0, ""), (1, "own-1.0")]


def test_licenses_know_whole_texts():
    """Bodies and single passages name their license, not one that shares some of their words."""
    a = licenses.built(licenses.TEMPLATES, licenses.BASE_PHRASES)
    found = lambda text: {s["label"] for s in licenses.scan_words(licenses.words_of(text.encode()), a)["spans"]}
    for label, text in licenses.TEXTS.items():
        assert found("x y z " + text.upper() + " more") == {label}, label
        assert all(label in found(p) for p in licenses.passages(text)), label
    assert found("The software is provided 'as is', without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.") == {"mit"}
    for label in ("agpl-3.0", "lgpl-3.0", "gpl-3.0", "gpl-2.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-4.0", "epl-2.0"):
        assert found(licenses.TEMPLATES[label][-1 if label not in licenses.TEXTS else 1]) == {label}
    assert not found("this is plain prose about the terms of a program and the rights of its users " * 9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=4), st.text("abcd", max_size=40))
def test_matching_statistics(templates, text):
    """The automaton's run after each word is the longest stretch ending there that a template has."""
    a = licenses.TemplateAutomaton({str(i): [" ".join(t)] for i, t in enumerate(templates)}, {})
    ids = np.array([a.vocabulary.get(c.encode(), 0) for c in text], dtype=np.int64)
    for i, state, n in a.run(ids, 0):
        want = max((k for k in range(len(text) + 1) for t in templates if k <= i + 1 and text[i + 1 - k : i + 1] in t), default=0)
        assert n == want
        if n:
            assert all(text[i + 1 - n : i + 1] == templates[q][e + 1 - n : e + 1] for q, e in a.ends[state])
