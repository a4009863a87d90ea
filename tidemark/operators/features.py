"""Feature views: vectors of a working set's columns."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import number


def words(col: str):
    return F.filter(F.split(F.coalesce(F.col(col).cast("string"), F.lit("")), " ", -1), lambda x: x != "")


def vocabulary(df: DataFrame, col: str) -> list[str]:
    """The column's distinct words, sorted."""
    return [r.w for r in df.select(F.explode(words(col)).alias("w")).distinct().orderBy("w").collect()]


def one_hot(df: DataFrame, col: str, out: str | None = None, vocab: list[str] | None = None) -> DataFrame:
    """Adds a vector with 1 at each word that the column has."""
    vocab = vocabulary(df, col) if vocab is None else vocab
    model = CountVectorizerModel.from_vocabulary(vocab or [""], inputCol="_words", outputCol=out or f"{col}_vector")
    model.setBinary(True)
    return model.transform(df.withColumn("_words", words(col))).drop("_words")


def numeric(df: DataFrame, col: str, out: str | None = None, default: float = 0.0) -> DataFrame:
    """Adds the column as a vector of one number; ``default`` where it is none."""
    return df.withColumn(out or f"{col}_vector", array_to_vector(F.array(number(col, default))))


def feature_view(df: DataFrame, columns: list[tuple[str, str]], out: str = "features") -> DataFrame:
    """Adds one vector of all columns, in their order. A kind is ``categorical``, ``text`` or anything else for a number."""
    made = []
    for i, (c, kind) in enumerate(columns):
        name = f"_feature_{i}"
        df = one_hot(df, c, name) if kind in ("categorical", "text") else numeric(df, c, name)
        made.append(name)
    return VectorAssembler(inputCols=made, outputCol=out).transform(df).drop(*made)


