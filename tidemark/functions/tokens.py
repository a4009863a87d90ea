"""Tokenizers: string column to array-of-strings column, built-in functions only.

Tokens form a bag: repeated tokens stay. A null is an empty string and gives no tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _filled(tokens: Column) -> Column:
    return F.filter(tokens, lambda x: x != F.lit(""))


def delimiter(chars: str = ".,?!\t ") -> Tokenizer:
    """Splits at each of ``chars``; every character is a delimiter of its own."""
    escaped = "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in chars)
    return lambda c: _filled(F.split(_text(c), f"[{escaped}]+", -1))


def word() -> Tokenizer:
    """Runs of ASCII letters, digits and underscores."""
    return lambda c: F.regexp_extract_all(_text(c), F.lit("[A-Za-z0-9_]+"), F.lit(0))


def whole() -> Tokenizer:
    """The whole string as one token."""
    return lambda c: _filled(F.array(_text(c)))


def white_space() -> Tokenizer:
    """Splits at runs of white space."""
    return lambda c: _filled(F.split(_text(c), r"\s+", -1))


def gram(n: int) -> Tokenizer:
    """Overlapping character n-grams; a shorter string is its own gram."""
    if n < 1:
        raise ValueError("a gram has a character at least")

    def run(c: Column) -> Column:
        t = _text(c)
        grams = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.when(F.length(t) < n, _filled(F.array(t))).otherwise(grams)

    return run


def white_space_punctuation() -> Tokenizer:
    """Splits at runs of white space and of ``. , ! ? : ; ' " -``."""
    return lambda c: _filled(F.split(F.trim(_text(c)), r"""([.,!?:;'"\-]|\s)+""", -1))


def tokenize(tokenizer: Tokenizer, *columns: Column | str) -> Column:
    """Tokens of several columns, one after the other."""
    parts = [tokenizer(F.col(c) if isinstance(c, str) else c) for c in columns]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


BY_NAME: dict[str, Callable[..., Tokenizer]] = {
    "delimiter": delimiter,
    "word": word,
    "null": whole,
    "whitespace": white_space,
    "gram": gram,
    "whitespace_punctuation": white_space_punctuation,
}
