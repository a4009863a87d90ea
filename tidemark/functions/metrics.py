"""Named string metrics on pairs of columns.

The five token metrics are built-in expressions on white-space tokens. The others follow their published
definitions and run as Arrow-batched pandas functions that work each distinct pair of a batch out once.
Nulls count as empty strings. Similarities lie between 0 and 1; Levenshtein is a distance.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import edit_distance, similarity
from .tokens import white_space


def _tokens(s: str) -> list[str]:
    return s.split()


def _grams(s: str, n: int = 3) -> Counter:
    padded = "#" * (n - 1) + s + "#" * (n - 1)
    return Counter(padded[i : i + n] for i in range(len(padded) - n + 1)) if s else Counter()


def jaro(a: str, b: str) -> float:
    """Matching characters within half the longer length, less half the transposed ones."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro, raised for a common prefix of up to four characters."""
    base = jaro(a, b)
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return base + prefix * scale * (1 - base)


def block_distance(a: str, b: str) -> float:
    """One less the city-block distance of the token counts over the number of tokens."""
    x, y = Counter(_tokens(a)), Counter(_tokens(b))
    total = sum(x.values()) + sum(y.values())
    return 1.0 if not total else 1 - sum(abs(x[t] - y[t]) for t in x | y) / total


def euclidean(a: str, b: str) -> float:
    """One less the Euclidean distance of the token counts over its largest value."""
    x, y = Counter(_tokens(a)), Counter(_tokens(b))
    n, m = sum(x.values()), sum(y.values())
    most = math.sqrt(n * n + m * m)
    return 1.0 if not most else (most - math.sqrt(sum((x[t] - y[t]) ** 2 for t in x | y))) / most


def matching_coefficient(a: str, b: str) -> float:
    """Common tokens over the longer list's length."""
    x, y = Counter(_tokens(a)), Counter(_tokens(b))
    most = max(sum(x.values()), sum(y.values()))
    return 1.0 if not most else sum((x & y).values()) / most


def overlap_coefficient(a: str, b: str) -> float:
    """Common distinct tokens over the smaller set's size."""
    x, y = set(_tokens(a)), set(_tokens(b))
    least = min(len(x), len(y))
    return (1.0 if not x and not y else 0.0) if not least else len(x & y) / least


def q_grams(a: str, b: str) -> float:
    """One less the distance of the padded trigram counts over their number."""
    x, y = _grams(a), _grams(b)
    total = sum(x.values()) + sum(y.values())
    return 1.0 if not total else 1 - sum(abs(x[t] - y[t]) for t in x | y) / total


def length_deviation(a: str, b: str) -> float:
    """The shorter length over the longer."""
    return 1.0 if not a and not b else min(len(a), len(b)) / max(len(a), len(b))


def mean_length(a: str, b: str) -> float:
    """Nearer 1 the more characters the two have together, up to 500."""
    n = len(a) + len(b)
    return 1.0 if n > 500 else 1 - ((500 - n) / 500) ** 4


def needleman_wunsch(a: str, b: str, gap: float = 2.0) -> float:
    """Global alignment cost (1 a mismatch, ``gap`` a gap), scaled by its largest value."""
    if not a and not b:
        return 1.0
    row = [j * gap for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i * gap
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + gap, row[j - 1] + gap)
    most, least = max(len(a), len(b)) * max(gap, 1.0), 0.0
    return 1 - (row[-1] - least) / (most - least)


def smith_waterman(a: str, b: str, match: float = 1.0, mismatch: float = -2.0, gap: float = -0.5) -> float:
    """Best local alignment over that of the shorter string with itself."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    row, best = [0.0] * (len(b) + 1), 0.0
    for x in a:
        last = 0.0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], max(0.0, last + (match if x == y else mismatch), row[j] + gap, row[j - 1] + gap)
            best = max(best, row[j])
    return best / (min(len(a), len(b)) * match)


#: Letters that sound alike, for partial matches in Gotoh's alignments.
ALIKE = [set("dt"), set("gj"), set("lr"), set("mn"), set("bpv"), set("aeiou"), set(",.")]


def _sound_score(x: str, y: str) -> float:
    return 5.0 if x == y else 3.0 if any(x in g and y in g for g in ALIKE) else -3.0


def smith_waterman_gotoh(a: str, b: str, window: int | None = None) -> float:
    """Best local alignment with affine gaps (5 to open, 1 to extend), letters that sound alike match in part.

    ``window`` bounds a gap's length.
    """
    a, b = a.lower(), b.lower()
    if not a or not b:
        return 1.0 if a == b else 0.0
    low = float("-inf")
    m, up, best = [0.0] * (len(b) + 1), [low] * (len(b) + 1), 0.0
    width = [0] * (len(b) + 1)
    for x in a:
        last, left, left_n = 0.0, low, 0
        for j, y in enumerate(b, 1):
            opened, longer = m[j] - 5, up[j] - 1 if window is None or width[j] < window else low
            up[j], width[j] = (opened, 1) if opened >= longer else (longer, width[j] + 1)
            opened, longer = m[j - 1] - 5, left - 1 if window is None or left_n < window else low
            left, left_n = (opened, 1) if opened >= longer else (longer, left_n + 1)
            last, m[j] = m[j], max(0.0, last + _sound_score(x, y), up[j], left)
            best = max(best, m[j])
    return best / (5.0 * min(len(a), len(b)))


def smith_waterman_gotoh_windowed(a: str, b: str) -> float:
    return smith_waterman_gotoh(a, b, 100)


def soundex(s: str) -> str:
    """American Soundex; empty without a letter."""
    digit = {c: d for d, group in zip("123456", ("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), strict=True) for c in group}
    letters = [c for c in s.upper() if "A" <= c <= "Z"]
    if not letters:
        return ""
    out, last = letters[0], digit.get(letters[0])
    for c in letters[1:]:
        d = digit.get(c)
        if d and d != last:
            out += d
        if c not in "HW":
            last = d
    return (out + "000")[:4]


def soundex_similarity(a: str, b: str) -> float:
    """Jaro-Winkler of the Soundex codes."""
    return jaro_winkler(soundex(a), soundex(b))


def matching_soundex(a: str, b: str) -> float:
    """Mean, over the first string's words, of the best Soundex similarity with a word of the other."""
    x, y = _tokens(a), _tokens(b)
    return (1.0 if not x and not y else 0.0) if not x or not y else sum(max(soundex_similarity(s, t) for t in y) for s in x) / len(x)


def ordered_name(a: str, b: str) -> float:
    """Mean, over aligned words from the end, of Soundex and Smith-Waterman similarity; later words weigh more."""
    x, y = _tokens(a), _tokens(b)
    n = min(len(x), len(y))
    if not n:
        return 1.0 if not x and not y else 0.0
    total = weights = 0.0
    for i in range(1, n + 1):
        w = 1.0 - 0.25 * min(i - 1, 3)
        weights += w
        total += w * (soundex_similarity(x[-i], y[-i]) + smith_waterman(x[-i], y[-i])) / 2
    return total / weights


def monge_elkan(a: str, b: str) -> float:
    """Mean, over the first string's words, of the best alignment with a word of the other."""
    x, y = _tokens(a), _tokens(b)
    return (1.0 if not x and not y else 0.0) if not x or not y else sum(max(smith_waterman_gotoh(s, t) for t in y) for s in x) / len(x)


def tag_link_token(a: str, b: str) -> float:
    """Common characters within a window, nearer ones counting more, over the longer length.

    No published definition of this metric is known here; this one is the library's own.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach, taken, score = max(len(a), len(b)) // 3, [False] * len(b), 0.0
    for i, c in enumerate(a):
        for j in sorted(range(max(0, i - reach), min(len(b), i + reach + 1)), key=lambda j, i=i: abs(i - j)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                score += 1 - abs(i - j) / (2.0 * max(1, reach + 1))
                break
    return score / max(len(a), len(b))


PYTHON: dict[str, Callable[[str, str], float]] = {
    "BlockDistance": block_distance,
    "ChapmanLengthDeviation": length_deviation,
    "ChapmanMatchingSoundex": matching_soundex,
    "ChapmanMeanLength": mean_length,
    "ChapmanOrderedNameCompoundSimilarity": ordered_name,
    "EuclideanDistance": euclidean,
    "Jaro": jaro,
    "JaroWinkler": jaro_winkler,
    "MatchingCoefficient": matching_coefficient,
    "MongeElkan": monge_elkan,
    "NeedlemanWunch": needleman_wunsch,
    "OverlapCoefficient": overlap_coefficient,
    "QGramsDistance": q_grams,
    "SmithWaterman": smith_waterman,
    "SmithWatermanGotoh": smith_waterman_gotoh,
    "SmithWatermanGotohWindowedAffine": smith_waterman_gotoh_windowed,
    "Soundex": soundex_similarity,
    "TagLinkToken": tag_link_token,
}
BUILT_IN = {"JaccardSimilarity": "jaccard", "DiceSimilarity": "dice", "CosineSimilarity": "cosine", "OverlapSimilarity": "overlap"}
#: Metrics that see only the letters A to Z.
LETTERS_ONLY = {"Soundex", "ChapmanMatchingSoundex", "ChapmanOrderedNameCompoundSimilarity"}


def string_metric(name: str, a: Column, b: Column) -> Column:
    """The named metric of two string columns, as a double."""
    x, y = F.coalesce(a.cast("string"), F.lit("")), F.coalesce(b.cast("string"), F.lit(""))
    if name in BUILT_IN:
        return similarity(BUILT_IN[name], white_space()(x), white_space()(y))
    if name == "Levenshtein":
        return edit_distance(white_space()(x), white_space()(y)).cast("double")
    if name not in PYTHON:
        raise ValueError(f"unknown string metric {name!r}")
    if name in LETTERS_ONLY:
        x, y = F.regexp_replace(x, "[^A-Za-z ]", ""), F.regexp_replace(y, "[^A-Za-z ]", "")
    one = PYTHON[name]

    @F.pandas_udf("double")
    def run(p: pd.Series, q: pd.Series) -> pd.Series:
        once = lru_cache(maxsize=100_000)(one)
        return pd.Series([once(s, t) for s, t in zip(p, q, strict=True)], dtype="float64")

    return run(x, y)


def features(names: list[str], a: list[Column], b: list[Column]) -> Column:
    """Array of metric values of two column lists, each joined by blanks."""
    x = F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in a])
    y = F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in b])
    return F.array(*[string_metric(n, x, y) for n in names])


def ensemble(*parts: Column) -> Column:
    """Feature arrays one after the other."""
    return F.concat(*parts)
