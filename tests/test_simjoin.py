"""Join fixtures: 100 random rows and 100 derived ones, so that exactly 100 pairs reach a known similarity."""

import math
import random
import string
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.functions import tokens
from tidemark.operators import simjoin
from tidemark.operators.graph import connected_components


def rows(spark, extra=0, keep=10, seed=3):
    r = random.Random(seed)
    token = lambda: "".join(r.choices(string.ascii_lowercase, k=7))
    base = [[token() for _ in range(10)] for _ in range(100)]
    more = [b[:keep] + [token() for _ in range(extra)] for b in base]
    return spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(base + more)], "id long, record string").repartition(4)


@pytest.mark.parametrize(
    ("name", "extra", "keep", "at", "above", "weighted"),
    [
        ("jaccard", 10, 10, 0.5, 0.51, False),
        ("jaccard", 10, 10, 0.465, 0.466, True),
        ("dice", 5, 10, 0.8, 0.81, False),
        ("cosine", 30, 10, 0.5, 0.51, False),
        ("overlap", 0, 5, 5, 6, False),
        ("overlap", 0, 5, 9.99, 10.01, True),
    ],
)
def test_prefix_join_fixtures(spark, name, extra, keep, at, above, weighted):
    df = rows(spark, extra, keep)
    join = lambda t: simjoin.prefix(df, id="id", cols=["record"], tokenizer=tokens.white_space(), similarity_name=name, threshold=t, weighted=weighted)
    assert {(r.id_a, r.id_b) for r in join(at).collect()} == {(i, i + 100) for i in range(100)}
    assert join(above).count() == 0


def test_edit_join_fixture(spark):
    df = rows(spark)
    short = df.where("id < 100").selectExpr("id + 100 AS id", "substring(record, 1, length(record) - 10) AS record")
    both = df.where("id < 100").unionByName(short)
    assert {(r.id_a, r.id_b, r.sim) for r in simjoin.edit(both, id="id", cols=["record"], threshold=10).collect()} == {(i, i + 100, 10.0) for i in range(100)}
    assert simjoin.edit(both, id="id", cols=["record"], threshold=9).count() == 0


WORDS = st.lists(st.sampled_from("a b c d e f".split()), max_size=6).map(" ".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(WORDS, min_size=2, max_size=14), st.sampled_from(["jaccard", "dice", "cosine", "overlap"]), st.floats(0.2, 0.95), st.booleans())
def test_prefix_join_equals_naive(spark, texts, name, threshold, weighted):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)
    key = lambda d: {(r.id_a, r.id_b) for r in d.collect()}
    got = key(simjoin.prefix(df, id="id", cols=["t"], similarity_name=name, threshold=threshold, weighted=weighted))
    want = key(simjoin.naive(df, id="id", cols=["t"], similarity_name=name, threshold=threshold, weighted=weighted))
    equal = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] == texts[j] and texts[i]}
    assert want <= got <= want | equal


def test_two_tables_and_min_size(spark):
    a = spark.createDataFrame([(1, "x y"), (2, "z")], "id long, t string")
    b = spark.createDataFrame([(1, "x y"), (3, "x y"), (4, "z")], "id long, t string")
    got = {(r.id_a, r.id_b) for r in simjoin.prefix(a, b, id="id", cols=["t"], threshold=0.9).collect()}
    assert got == {(1, 3), (2, 4)}
    assert {(r.id_a, r.id_b) for r in simjoin.prefix(a, b, id="id", cols=["t"], threshold=0.9, min_size=2).collect()} == {(1, 3)}
    assert simjoin.prefix(a.limit(0), id="id", cols=["t"]).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("abc", max_size=7), min_size=2, max_size=10), st.integers(1, 3))
def test_edit_join_equals_brute_force(spark, texts, limit):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if distance(texts[i], texts[j]) <= limit}
    assert {(r.id_a, r.id_b) for r in simjoin.edit(df, id="id", cols=["t"], threshold=limit).collect()} == want


def test_connected_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edit_join_compares_copies_once(spark, monkeypatch):
    """40 rows of each of 30 names, with an id of their own: pairs of rows are made at the end, pairs of texts before."""
    written, materialize = {}, simjoin.materialize

    def spy(df, tag):
        out = materialize(df, tag)
        written[tag] = out.count()
        return out

    monkeypatch.setattr(simjoin, "materialize", spy)
    a = spark.range(1200).selectExpr("id", "concat('Supplier#', lpad(id % 30, 9, '0')) AS name")
    b = spark.range(1200, 2400).selectExpr("id", "concat('Customer#', lpad(id % 30, 9, '0')) AS name")
    near = sum(sum(p != q for p, q in zip(f"{i:02}", f"{j:02}", strict=True)) <= 1 for i in range(30) for j in range(30))
    assert simjoin.edit(a, b, id="id", cols=["name"], threshold=6).count() == near * 1600
    assert written["near"] == near
    assert simjoin.edit(a, id="id", cols=["name"], threshold=1).count() == (near - 30) // 2 * 1600 + 30 * 780
    assert written["near"] == (near - 30) // 2 + 30


@pytest.mark.parametrize("few", [0, 1 << 60])
def test_edit_join_of_texts_with_common_ends(spark, monkeypatch, few):
    monkeypatch.setattr(simjoin, "_FEW_PAIRS", few)
    texts = ["aXb", "aXXb", "ab", "aYb", "aXYZb", "a\U0001d11eb", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {(r.id_a, r.id_b, r.sim) for r in simjoin.edit(df, id="id", cols=["t"], threshold=1).collect()}
    assert got == {(0, 1, 1.0), (0, 2, 1.0), (0, 3, 1.0), (0, 5, 1.0), (0, 6, 1.0), (2, 3, 1.0), (2, 5, 1.0), (2, 6, 0.0), (3, 5, 1.0), (3, 6, 1.0), (5, 6, 1.0)}


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("name", ["jaccard", "overlap"])
def test_prefix_join_over_many_blocks(spark, monkeypatch, name, weighted):
    """Blocks of a few rows, one and two tables: the pairs of the naive join, and a scratch folder not much above the bags."""
    from tidemark.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_ROWS", 7)
    monkeypatch.setattr(blocks, "TOGETHER", 2)
    r = random.Random(5)
    bags = [[r.choice("abcdefghij") for _ in range(r.randint(0, 12))] for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bags)], "id long, t string")
    options = {"id": "id", "cols": ["t"], "similarity_name": name, "threshold": 0.6 if name == "jaccard" else 2.5, "weighted": weighted}
    got = lambda d: {(x.id_a, x.id_b): round(x.sim, 9) for x in d.collect()}
    assert got(simjoin.prefix(df, **options)) == got(simjoin.naive(df, **options)) != {}
    part = df.where("id % 3 = 0")
    if not weighted:
        assert got(simjoin.prefix(part, df, **options)) == got(simjoin.naive(part, df, **options))


def test_prefix_join_writes_no_candidates(spark, tmp_path):
    """300 rows of 30 words that all share 8 rare ones: 44,850 candidates by prefix before, none written now."""
    from tidemark.operators import blocks

    rows = [(i, " ".join([f"x{k}" for k in range(8)] + [f"own{i}_{k}" for k in range(22)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t string")
    written, materialize = {}, blocks.materialize

    def spy(d, tag):
        out = materialize(d, tag)
        written[tag] = out.count()
        return out

    blocks.materialize = spy
    try:
        assert simjoin.prefix(df, id="id", cols=["t"], threshold=0.7).count() == 0
    finally:
        blocks.materialize = materialize
    assert written == {"pairs": 0}


@pytest.mark.parametrize("name", ["jaccard", "dice", "cosine"])
@pytest.mark.parametrize("weighted", [False, True])
def test_prefix_join_meets_few_pairs_before_comparing(spark, name, weighted):
    """400 rows that share 20 frequent words of 60 and lie in one block: hardly a pair meets in first parts, none of the 40 matches is lost."""
    from tidemark.operators import blocks

    r = random.Random(2)
    common = [f"c{k}" for k in range(24)]
    texts = [" ".join(r.sample(common, 20) + [f"w{r.randrange(4000)}" for _ in range(40)]) for _ in range(360)]
    texts += [t.rsplit(" ", 1)[0] + " new" for t in texts[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    rows = df.select("id", tokens.word()(df.t).alias("tokens"))
    sample, one_in = blocks._sample(rows, 400.0)
    hashed = rows.selectExpr("transform(tokens, x -> xxhash64(x)) AS h")
    path, found = blocks._written(rows, blocks._frequencies(hashed, 2) if weighted else None, 400.0, 1.0, blocks._frequent(sample), sample, one_in, 0)
    assert len(found) == 1
    x = blocks._Block(f"{path}/block={found[0][0]}", name, 0.8, 400.0)
    cut = x.cut(blocks.least(name, 0.8, x.total), name)
    assert len(blocks._meetings(x, x, cut, cut)[0]) < 0.25 * 400 * 399 / 2
    assert sum(len(i) for i, *_ in blocks._pairs(x, x, name, 0.8)) == 40
    got = {(p.id_a, p.id_b) for p in simjoin.prefix(df, id="id", cols=["t"], similarity_name=name, threshold=0.8, weighted=weighted).collect()}
    assert got == {(i, 360 + i) for i in range(40)}


@pytest.mark.parametrize("weighted", [False, True])
def test_join_of_a_part_with_its_table_writes_bags_once(spark, monkeypatch, weighted):
    from tidemark.operators import blocks

    calls, written = [], blocks._written
    monkeypatch.setattr(blocks, "_written", lambda *a: calls.append(1) or written(*a))
    r = random.Random(9)
    full = spark.createDataFrame([(i, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 9)))) for i in range(80)] + [(80, None)], "id long, t string")
    part = full.where("id % 3 = 0")
    options = {"id": "id", "cols": ["t"], "threshold": 0.6, "weighted": weighted}
    got = lambda d: {(x.id_a, x.id_b) for x in d.collect()}
    texts = {x.id: x.t for x in full.collect()}
    once = simjoin.prefix(part, full, **options)
    assert len(calls) == 1
    changed = full.where("id <> 0").union(spark.createDataFrame([(0, "other words")], "id long, t string"))
    assert got(once) - got(simjoin.prefix(part, changed, **options)) == {p for p in got(once) if p[1] == 0}
    assert len(calls) == 3
    if not weighted:
        assert got(once) == got(simjoin.naive(part, full, **options))
    assert all(texts[i] and texts[j] for i, j in got(once))


def test_splits_take_off_what_leads_cost():
    """Supplier# and Customer# lie 5 edits apart, so of 6 what follows has one left; leads that cost nothing change nothing."""
    assert simjoin._splits("Supplier#", "Customer#", 6) == [(9, 8, 0), (9, 9, 1), (9, 10, 0)]
    assert simjoin._splits("", "ab", 2) == [(0, 0, 2)]
    assert simjoin._splits("Supplier#", "Customer#", 4) == []

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    r = random.Random(4)
    word = lambda n: "".join(r.choices("ab", k=r.randint(0, n)))
    for _ in range(3000):
        p, q, limit = word(4), word(4), r.randint(0, 4)
        x, y = p + word(4), q + word(4)
        if distance(x, y) <= limit:
            assert any(k <= len(y) and distance(x[n:], y[k:]) <= left for n, k, left in simjoin._splits(p, q, limit))


def test_edit_join_of_tables_with_leads(spark, monkeypatch):
    """500 by 500 names whose leads use up the limit: no more rows meet than match."""
    monkeypatch.setattr(simjoin, "_FEW_PAIRS", 0)
    a = spark.range(500).selectExpr("id", "concat('Supplier#', lpad(id * 3, 9, '0')) AS name")
    b = spark.range(500).selectExpr("id + 500 AS id", "concat('Customer#', lpad(id * 2, 9, '0')) AS name")
    got = {(x.id_a, x.id_b, x.sim) for x in simjoin.edit(a, b, id="id", cols=["name"], threshold=5).collect()}
    assert got == {(2 * i, 500 + 3 * i, 5.0) for i in range(167)}
    close = {(x.id_a, x.id_b) for x in simjoin.edit(a, b, id="id", cols=["name"], threshold=6).collect()}
    want = {(x.id_a, x.id_b) for x in a.selectExpr("id AS id_a", "name AS p").crossJoin(b.selectExpr("id AS id_b", "name AS q")).where("levenshtein(p, q) <= 6").collect()}
    assert close == want > {p[:2] for p in got}


@pytest.mark.parametrize("weighted", [False, True])
def test_overlap_multiplies_what_many_rows_have(spark, monkeypatch, weighted):
    """300 rows of 30 frequent words, up to 40 times each: hardly a meeting of two rows is listed, all sums are exact, also above the times told apart."""
    from tidemark.operators import blocks

    monkeypatch.setattr(blocks, "TIMES", 16)
    monkeypatch.setattr(blocks, "COLUMNS", 50)
    r = random.Random(7)
    texts = [" ".join(w for k in range(30) for w in [f"c{k}"] * (r.randint(0, 3) if r.random() < 0.97 else 40)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(3)
    rows = df.select("id", tokens.word()(df.t).alias("tokens"))
    sample, one_in = blocks._sample(rows, 300.0)
    paths = blocks._frequencies(rows.selectExpr("transform(tokens, x -> xxhash64(x)) AS h"), 2) if weighted else None
    path, found = blocks._written(rows, paths, 300.0, 1.0, blocks._frequent(sample), sample, one_in, 0)
    x = blocks._Block(f"{path}/block={found[0][0]}", "overlap", 1.0, 300.0)
    listed, bincount = [], blocks.np.bincount
    monkeypatch.setattr(blocks.np, "bincount", lambda a, w=None, n=0, **o: listed.append(len(a) if w is not None else 0) or bincount(a, w, n, **o) if w is not None else bincount(a, **{"minlength": n, **o}))
    t = 4.0 if weighted else 50.0
    got = sum(len(i) for i, *_ in blocks._pairs(x, x, "overlap", t))
    assert sum(listed) < 0.1 * 300 * 299 / 2 * 30
    monkeypatch.undo()
    bags = [Counter(x.split()) for x in texts]
    df_of = Counter(w for b in bags for w in b)
    weight = {w: math.log10(300 / n) if weighted else 1.0 for w, n in df_of.items()}
    shared = {(i, j): sum(min(n, bags[j][w]) * weight[w] for w, n in bags[i].items()) for i in range(300) for j in range(i + 1, 300)}
    want = {k: pytest.approx(v) for k, v in shared.items() if v >= t}
    assert 100 < got == len(want) < 44_000
    assert {(p.id_a, p.id_b): p.sim for p in simjoin.prefix(df, id="id", cols=["t"], similarity_name="overlap", threshold=t, weighted=weighted).collect()} == want


@pytest.mark.parametrize(("name", "t"), [("jaccard", 0.7), ("dice", 0.8), ("overlap", 30)])
@pytest.mark.parametrize("weighted", [False, True])
def test_copies_are_compared_once(spark, monkeypatch, name, t, weighted):
    """90 rows of each of 4 texts, of which two match: a pair of bags meets for them, 360 * 359 / 2 pairs of rows before; all pairs of rows come out."""
    from tidemark.operators import blocks

    monkeypatch.setattr(blocks, "ROWS_OUT", 1000)
    words = [[f"w{g}_{k}" for k in range(40)] for g in range(3)]
    texts = [" ".join(w) for w in [*words, [*words[0][:39], "other"]]]
    df = spark.createDataFrame([(i, texts[i % 4]) for i in range(360)], "id long, t string").repartition(3)
    rows = df.select("id", tokens.word()(df.t).alias("tokens"))
    sample, one_in = blocks._sample(rows, 360.0)
    paths = blocks._frequencies(rows.selectExpr("transform(tokens, x -> xxhash64(x)) AS h"), 2) if weighted else None
    path, found = blocks._written(rows, paths, 360.0, 1.0, blocks._frequent(sample), sample, one_in, 0)
    at = t / 3 if weighted and name == "overlap" else t  # a word of 90 or 180 rows weighs 0.6 or 0.3
    x = blocks._Block(f"{path}/block={found[0][0]}", name, at, 360.0)
    assert sum(len(i) for i, *_ in blocks._pairs(x, x, name, at)) == 1
    got = [(p.id_a, p.id_b) for p in simjoin.prefix(df, id="id", cols=["t"], similarity_name=name, threshold=at, weighted=weighted).collect()]
    alike = lambda i, j: i % 4 == j % 4 or {i % 4, j % 4} == {0, 3}
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i in range(360) for j in range(i + 1, 360) if alike(i, j)}


def test_edit_join_pairs_rows_in_many_tasks(spark, monkeypatch):
    """600 rows of one name: their 179,700 pairs are made by all tasks, not by one."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(simjoin, "_ROWS_TOGETHER", 50)
    df = spark.range(600).selectExpr("id", "'one name' AS name").unionByName(spark.createDataFrame([(600, "one names"), (None, "one name")], "id long, name string"))
    out = simjoin.edit(df, id="id", cols=["name"], threshold=1)
    by = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in by) == 600 * 599 // 2 + 600
    assert max(r.n for r in by) < 0.6 * (600 * 599 // 2)
    assert out.distinct().count() == 600 * 599 // 2 + 600
    assert {r.sim for r in out.filter("id_b = 600").collect()} == {1.0}


def test_match_sequence_of_copies_in_many_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tidemark.operators import matchers

    monkeypatch.setattr(simjoin, "_ROWS_TOGETHER", 50)
    df = spark.range(400).selectExpr("id", "'one name' AS name")
    sequence = matchers.MatchSequence(lambda a: simjoin.edit(a, id="id", cols=["name"], threshold=1)).add(matchers.by_similarity(1 - (F.col("id_a") + F.col("id_b")) % 2, 1))
    by = [r.n for r in sequence.run(df).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()]
    assert sum(by) == 2 * (200 * 199 // 2) and max(by) < 0.6 * sum(by)


@pytest.mark.parametrize("weighted", [False, True])
def test_blocks_take_little_of_a_frequent_token(spark, monkeypatch, weighted):
    """Bags of tokens that the sample names take less than half of the 8 + 4 (+ 4 weighted) bytes a token has, and weigh what they did."""
    from tidemark.operators import blocks

    monkeypatch.setattr(blocks, "ORDER_ROWS", 200)
    r = random.Random(17)
    texts = {i: " ".join(f"t{r.randrange(3000)}" for _ in range(400)) + f" only{i}" for i in range(400)}
    rows = spark.createDataFrame(list(texts.items()), "id long, t string").selectExpr("id", "split(t, ' ') AS tokens").coalesce(1)
    sample, one_in = blocks._sample(rows, 400.0)
    paths = blocks._frequencies(rows.selectExpr("transform(tokens, x -> xxhash64(x)) AS h"), 2) if weighted else None
    path, found = blocks._written(rows, paths, 400.0, 1.0, blocks._frequent(sample), sample, one_in, 0)
    fs, names = blocks._files(f"{path}/block={found[0][0]}")
    assert len(found) == 1
    bags = [Counter(t.split()) for t in texts.values()]
    size = sum(fs.get_file_info(n).size for n in names)
    assert size < 0.5 * (16 if weighted else 12) * sum(len(b) for b in bags)
    df = Counter(t for b in bags for t in b)
    want = [sum(n * (math.log10(400 / df[t]) if weighted else 1) for t, n in b.items()) for b in bags]
    block = blocks._Block(f"{path}/block={found[0][0]}", "jaccard", 0.7, 400.0)
    assert block.total.tolist() == pytest.approx(sorted(want), abs=1e-6)
    mass = block.n if block.w is None else block.n * block.w
    assert [mass[s:e].sum() for s, e in zip(block.starts, block.starts[1:], strict=False)] == pytest.approx(sorted(want), abs=1e-6)
