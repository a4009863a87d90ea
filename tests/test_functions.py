import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics, tokens
from tidemark.functions.similarity import edit_distance, metric, number, similarity


def one(spark, column, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items())) if cols else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("tokenizer", "text", "want"),
    [
        (tokens.word(), "it's  a_b,ñc ", ["it", "s", "a_b", "c"]),
        (tokens.delimiter(), "a.b,c?d!e\tf g", ["a", "b", "c", "d", "e", "f", "g"]),
        (tokens.delimiter("-]"), "a-b]c", ["a", "b", "c"]),
        (tokens.whole(), " a b ", [" a b "]),
        (tokens.white_space(), "  a \t b\nc ", ["a", "b", "c"]),
        (tokens.gram(3), "abcd", ["abc", "bcd"]),
        (tokens.gram(3), "ab", ["ab"]),
        (tokens.gram(2), "a\nbé", ["a\n", "\nb", "bé"]),
        (tokens.white_space_punctuation(), " a, b-c; 'd' ", ["a", "b", "c", "d"]),
    ],
)
def test_tokenizers(spark, tokenizer, text, want):
    assert one(spark, tokenizer(F.col("t")), t=text) == want
    assert one(spark, tokenizer(F.col("t")), t=None) == []


def test_tokenize_joins_columns(spark):
    assert one(spark, tokens.tokenize(tokens.word(), "a", "b"), a="x y", b="y") == ["x", "y", "y"]


# x occurs three and two times, y once each: three tokens in common, of six and five
BAG = {"a": ["x", "y", "x", "z", "x", "q"], "b": ["y", "x", "x", "r", "p"]}


@pytest.mark.parametrize(("name", "want", "weighted"), [("jaccard", 3 / 8, 2.5 / 12.5), ("overlap", 3.0, 2.5), ("dice", 6 / 11, 5 / 15), ("cosine", 3 / 30**0.5, 2.5 / 50**0.5)])
def test_bag_similarities(spark, name, want, weighted):
    """Weights: x 0.5, y 1.5, z 7, r 2.5; p and q have none. The bags weigh 10 and 5, what they share 2.5."""
    w = F.create_map(*[F.lit(x) for x in ("x", 0.5, "y", 1.5, "z", 7.0, "r", 2.5)])
    assert one(spark, similarity(name, F.col("a"), F.col("b")), **BAG) == pytest.approx(want)
    assert one(spark, similarity("Weighted" + name, F.col("a"), F.col("b"), w), **BAG) == pytest.approx(weighted)


def test_edit_distance_and_empty_bags(spark):
    words = {"a": ["kit", "ten"], "b": ["sit", "tin"]}
    assert one(spark, edit_distance(F.col("a"), F.col("b")), **words) == 2
    assert one(spark, edit_distance(F.col("a"), F.col("b"), 1), **words) == 2
    for name in ("jaccard", "dice", "cosine", "overlap"):
        assert one(spark, similarity(name, F.col("a"), F.col("b")), a=[], b=[]) == 0
    with pytest.raises(ValueError, match="unknown"):
        metric("hamming")


def test_number(spark):
    assert [one(spark, number("a", -1.0), a=x) for x in ("2.5", "x", None)] == [2.5, -1.0, -1.0]


def test_string_metrics_known_values():
    assert metrics.jaro("MARTHA", "MARHTA") == pytest.approx(0.944444, abs=1e-6)
    assert metrics.jaro_winkler("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)
    assert [metrics.soundex(x) for x in ("Robert", "Rupert", "Ashcraft", "Tymczak", "Pfister", "")] == ["R163", "R163", "A261", "T522", "P236", ""]
    assert metrics.block_distance("a b", "a c") == pytest.approx(0.5)
    assert metrics.overlap_coefficient("a b c", "a b") == 1.0
    assert metrics.needleman_wunsch("abc", "abd") == pytest.approx(1 - 1 / 6)
    for f in metrics.PYTHON.values():
        assert 0 <= f("night watch", "nacht wache") <= 1
        assert f("same words", "same words") == pytest.approx(1.0) or f is metrics.mean_length
        assert 0 <= f("", "") <= 1 and 0 <= f("", "x") <= 1


def test_string_metric_columns(spark):
    got = one(spark, metrics.features(["JaccardSimilarity", "DiceSimilarity", "CosineSimilarity", "OverlapSimilarity", "Levenshtein", "Jaro"], [F.col("a")], [F.col("b")]), a="a b c d", b="a b c d")
    assert got == [1, 1, 1, 4, 0, 1]
    assert one(spark, metrics.string_metric("Levenshtein", F.col("a"), F.col("b")), a="a ", b=" a") == 0
    assert one(spark, metrics.string_metric("Soundex", F.col("a"), F.col("b")), a=None, b="x1") == 0
    with pytest.raises(ValueError, match="unknown"):
        metrics.string_metric("Nope", F.col("a"), F.col("b"))
