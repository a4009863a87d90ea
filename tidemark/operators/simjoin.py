"""Similarity joins: naive (for small tables and as a check), prefix-filtered on tokens, segment-filtered on edit distance.

All give (id_a, id_b, sim). A self-join has each unordered pair once, id_a < id_b. With a second table every
pair of a row of ``a`` and a row of ``b`` with different ids appears, so a sample joined with its own full table gives both
directions of a pair that lies in the sample. Weights are ``log10(rows / rows with the token)`` over ``a``.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import Metric, bag_weight, edit_distance, intersection_weight, metric, similarity
from ..functions.tokens import Tokenizer, tokenize, word
from ..plans.scratch import materialize, shuffle_partitions, shuffles_removed
from . import blocks


def token_weights(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, df, weight) of the rows' tokens: rows with the token, and log10 of all rows over them."""
    each = rows.select(F.explode(F.array_distinct(tokens)).alias("token"))
    n = rows.agg(F.count("*").cast("double").alias("rows"))
    return each.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("token", "df", F.log10(F.col("rows") / F.col("df")).alias("weight"))


def _tokenized(df: DataFrame, id: str, cols: list[str], tokenizer: Tokenizer, min_size: int) -> DataFrame:
    out = df.select(F.col(id).alias("id"), tokenize(tokenizer, *cols).alias("tokens"))
    return out.withColumn("kept", F.size("tokens") >= min_size)


def naive(a: DataFrame, b: DataFrame | None = None, id: str = "hash", cols: list[str] | None = None, tokenizer: Tokenizer | None = None, similarity_name: str = "jaccard", threshold: float = 0.5, weighted: bool = False) -> DataFrame:
    """Every pair compared: quadratic by definition, a check for small tables. The weights' row count is that of ``b`` (of ``a``
    in a self-join). Bags with their weights are joined to the rows, nothing is collected."""
    cols, tokenizer, m = cols or [c for c in a.columns if c != id], tokenizer or word(), metric(similarity_name)
    x = _tokenized(a, id, cols, tokenizer, 0).select("id", "tokens")
    y = _tokenized(b, id, cols, tokenizer, 0).select("id", "tokens") if b is not None else x
    if weighted:
        n = F.broadcast(y.agg(F.count("*").cast("double").alias("rows")))
        known = token_weights(x).join(n).select("token", F.log10(F.col("rows") / F.col("df")).alias("w"))

        def with_map(rows: DataFrame) -> DataFrame:
            each = rows.select("id", F.explode(F.array_distinct("tokens")).alias("token")).join(known, "token")
            maps = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("weights"))
            return rows.join(maps, "id", "left").withColumn("weights", F.coalesce("weights", F.create_map().cast("map<string,double>")))

        x, y = with_map(x), with_map(y)
    else:
        x, y = x.withColumn("weights", F.lit(None)), y.withColumn("weights", F.lit(None))
    left = x.select(F.col("id").alias("id_a"), F.col("tokens").alias("ta"), F.col("weights").alias("wa"))
    right = y.select(F.col("id").alias("id_b"), F.col("tokens").alias("tb"), F.col("weights").alias("wb"))
    met = left.crossJoin(right).filter("id_a < id_b" if b is None else "id_a <> id_b")
    wa, wb = (F.col("wa"), F.col("wb")) if weighted else (None, None)
    value = m.value(intersection_weight(F.col("ta"), F.col("tb"), wa), bag_weight(F.col("ta"), wa), bag_weight(F.col("tb"), wb))
    return met.withColumn("sim", value).filter(m.matches(F.col("sim"), threshold)).select("id_a", "id_b", "sim")


def prefix(a: DataFrame, b: DataFrame | None = None, id: str = "hash", cols: list[str] | None = None, tokenizer: Tokenizer | None = None, similarity_name: str = "jaccard", threshold: float = 0.5, weighted: bool = False, min_size: int = 0) -> DataFrame:
    """Pairs of rows whose bags match, and of rows of equal token lists that weigh enough for it.

    Bags are compared block by block (``blocks``), so disk holds them once and no candidates. A pair without a common token is
    never found, whatever the threshold.
    """
    cols, tokenizer, m = cols or [c for c in a.columns if c != id], tokenizer or word(), metric(similarity_name)
    bags = lambda df: df.select(F.col(id).alias("id"), tokenize(tokenizer, *cols).alias("tokens"))
    if b is not None and _rows_of(a, b, id, cols):
        return _both_ways(a, b, id, blocks.compare(bags(b), None, m.name, float(threshold), weighted, min_size, bags(a)), m, threshold)
    met = blocks.compare(bags(a), bags(b) if b is not None else None, m.name, float(threshold), weighted, min_size)
    near = met.withColumn("sim", m.value(F.col("met"), F.col("total_x"), F.col("total_y"))).filter(m.matches(F.col("sim"), threshold) | F.col("same")).filter("id_x <> id_y")
    if b is None:
        return near.select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"), "sim")
    return near.select(F.col("id_x").alias("id_a"), F.col("id_y").alias("id_b"), "sim")


def _rows_of(a: DataFrame, b: DataFrame, id: str, cols: list[str]) -> bool:
    """Whether each row of ``a`` is one of ``b``, and ids are unique; rows are told by two 64-bit hashes of what is joined."""
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    keys = lambda df, side: df.select(F.col(id).alias("id"), F.xxhash64(*parts).alias("k"), F.xxhash64(F.lit("k"), *parts).alias("l"), F.lit(side).alias("side"))
    if any(dict(a.dtypes)[c] != dict(b.dtypes)[c] for c in (id, *cols)):
        return False
    by_id = keys(a, 0).unionByName(keys(b, 1)).groupBy("id").agg(*[F.count(F.when(F.col("side") == k, 1)).alias(f"n{k}") for k in (0, 1)], F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("l").alias("l0"), F.max("l").alias("l1"))
    odd = by_id.filter("id IS NULL OR n0 > 1 OR n1 <> 1 OR n0 = 1 AND (k0 <> k1 OR l0 <> l1)")
    with shuffles_removed(a.sparkSession):
        return odd.isEmpty()


def _both_ways(a: DataFrame, b: DataFrame, id: str, met: DataFrame, m: Metric, threshold: float) -> DataFrame:
    """Pairs within ``b``, both ways, of which the first is a row of ``a``: what a join of ``a`` with ``b`` gives, with bags written and compared once."""
    near = met.withColumn("sim", m.value(F.col("met"), F.col("total_x"), F.col("total_y"))).filter(m.matches(F.col("sim"), threshold) | F.col("same"))
    way = lambda p, q: near.select(F.col(f"id_{p}").alias("id_a"), F.col(f"id_{q}").alias("id_b"), "sim")
    return way("x", "y").unionByName(way("y", "x")).join(a.select(F.col(id).alias("id_a")), "id_a", "left_semi")


def segments(text: Column, length: Column, limit: int) -> Column:
    """Array of (nr, start, segment) of the ``limit + 1`` even pieces of a text of ``length``; the last are longer."""
    n = limit + 1
    short, longer = F.floor(length / n).cast("int"), (length % n).cast("int")
    at = lambda i: short * i + F.greatest(F.lit(0), i - (F.lit(n) - longer))
    return F.transform(F.sequence(F.lit(0), F.lit(limit)), lambda i: F.struct(i.alias("nr"), F.substring(text, at(i) + 1, at(i + 1) - at(i)).alias("segment")))


def _lead(texts: DataFrame, c: Column) -> str:
    """What all texts begin with."""
    ends = texts.agg(F.min(c).alias("low"), F.max(c).alias("high")).first()
    return os.path.commonprefix([ends["low"] or "", ends["high"] or ""])


def _without_common_ends(texts: DataFrame):
    """From the column of a text to it without what all texts begin with and end in, which adds no edits to any pair."""
    lead = len(_lead(texts, F.col("text")))
    inner = lambda c: F.substring(c, lead + 1, _LONGEST)
    tail = len(_lead(texts, F.reverse(inner(F.col("text")))))
    return lambda c: F.reverse(F.substring(F.reverse(inner(c)), tail + 1, _LONGEST))


def _splits(lead_x: str, lead_y: str, limit: int) -> list[tuple[int, int, int]]:
    """(from, from, edits): of two texts that begin with ``lead_x`` and ``lead_y`` and lie within ``limit`` edits, for one of these
    what follows after so many characters lies within so many edits. What the lead costs at least is taken off; a
    character that follows ``lead_y`` counts as any."""
    row = list(range(len(lead_x) + 1))  # edits from the beginnings of lead_x to k characters
    out = [(len(lead_x), 0, limit - row[-1])]
    for k in range(1, len(lead_x) + limit + 1):
        last, row = row, [k]
        for i, c in enumerate(lead_x, 1):
            row.append(min(last[i - 1] + (k <= len(lead_y) and c != lead_y[k - 1]), last[i] + 1, row[i - 1] + 1))
        out.append((len(lead_x), k, limit - row[-1]))
    out = [x for x in out if x[2] >= 0]
    return out if all(r < limit for _, _, r in out) else [(0, 0, limit)]


_LONGEST = (1 << 31) - 1
#: Up to so many pairs of like length are compared without counting how often segments meet.
_FEW_PAIRS = 20_000_000
#: Texts are told apart by what their beginnings cost if that takes no more joins than so many.
_MOST_JOINS = 12
#: Rows of equal texts that are paired in one task, about.
_ROWS_TOGETHER = 1000


def edit(a: DataFrame, b: DataFrame | None = None, id: str = "hash", cols: list[str] | None = None, tokenizer: Tokenizer | None = None, threshold: int = 1) -> DataFrame:
    """Pairs whose token texts (tokens joined by blanks) lie within ``threshold`` edits.

    Different texts are compared, each once; rows with equal texts join the result at the end. What all texts of a table begin
    with is compared with the other table's, and its edits are taken off the limit (``_splits``). One of ``threshold + 1`` even
    segments of the indexed text must stand in the other, near its own place: the multi-match-aware window of that place bounds
    where. Texts of equal length or shorter are indexed. Where common segments would meet more often than there are pairs of
    like length, those pairs are compared outright.
    """
    cols, t = cols or [c for c in a.columns if c != id], int(threshold)
    whole = lambda df: df.select(F.col(id).alias("id"), F.array_join(tokenize(tokenizer, *cols), " ").alias("text") if tokenizer else F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("text"))
    rows_x = materialize(whole(a), "texts")
    rows_y = materialize(whole(b), "texts") if b is not None else rows_x
    sided = rows_x.select("text", F.lit(0).alias("side"))
    if b is not None:
        sided = sided.unionByName(rows_y.select("text", F.lit(1).alias("side")))
    core = _without_common_ends(sided)
    every = materialize(sided.select(core(F.col("text")).alias("core"), "side").distinct(), "distinct")
    x = every.filter("side = 0").drop("side")
    y = every.filter("side = 1").drop("side") if b is not None else x
    lead = _lead(x, F.col("core")) if b is not None else ""
    splits = _splits(lead, _lead(y, F.col("core")), t) if b is not None else [(0, 0, t)]
    apart = splits != [(0, 0, t)] and sum(left + 1 for *_, left in splits) <= _MOST_JOINS
    near = None
    for from_x, from_y, most in splits:
        rest = lambda d, n: d.filter(F.length("core") >= n).select("core", F.substring("core", n + 1, _LONGEST).alias("part"), (F.length("core") - n).alias("length"))
        for left in range(most + 1) if apart else [most]:  # a text's own beginning may cost more than the least
            some = rest(y, from_y).filter(F.levenshtein(F.substring("core", 1, from_y), F.lit(lead)) == t - left) if apart else rest(y, from_y) if b is not None else None
            met = _near(rest(x, from_x), some, left, t)
            near = met if near is None else near.unionByName(met).distinct()
    if near is None:
        near = x.select(F.col("core").alias("core_i"), F.col("core").alias("core_p"), F.lit(0.0).alias("sim")).limit(0)
    if b is None:
        near = near.unionByName(x.select(F.col("core").alias("core_i"), F.col("core").alias("core_p"), F.lit(0.0).alias("sim")))
    near = materialize(near, "near")
    out = _rows_paired(near, *[d.select("id", core(F.col("text")).alias("core")) for d in (rows_x, rows_y)])
    if b is None:
        return out.filter("core_i <> core_p AND id_i <> id_p OR id_i < id_p").select(F.least("id_i", "id_p").alias("id_a"), F.greatest("id_i", "id_p").alias("id_b"), "sim")
    return out.filter("id_i <> id_p").select(F.col("id_i").alias("id_a"), F.col("id_p").alias("id_b"), "sim")


def _rows_paired(near: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """(core_i, core_p, sim, id_i, id_p) of the rows (id, core) that have the texts of a pair.

    Few pairs of texts may stand for very many of rows. So rows come in lists of ``_ROWS_TOGETHER`` or so, pairs of lists are dealt out
    to all partitions, and pairs of rows are made there.
    """

    def lists(rows: DataFrame, s: str) -> DataFrame:
        of_text = rows.groupBy("core").agg(F.ceil(F.count("*") / _ROWS_TOGETHER).alias("lists"))
        dealt = rows.join(of_text, "core").withColumn("list", F.pmod(F.xxhash64("id"), F.col("lists")))
        return dealt.groupBy("core", "list").agg(F.collect_list("id").alias(f"ids_{s}")).select(F.col("core").alias(f"core_{s}"), f"ids_{s}")

    pairs = near.join(lists(x, "i"), "core_i").join(lists(y, "p"), "core_p").repartition(shuffle_partitions(near.sparkSession))
    return pairs.select("core_i", "core_p", "sim", F.explode("ids_i").alias("id_i"), "ids_p").select("core_i", "core_p", "sim", "id_i", F.explode("ids_p").alias("id_p"))


def _near(x: DataFrame, y: DataFrame | None, t: int, limit: int) -> DataFrame:
    """(core_i, core_p, sim) of rows (core, part, length) whose cores lie within ``limit`` edits, of those whose parts lie within ``t``."""
    both_tables = y is not None
    y = y if both_tables else x
    of_length = lambda d: {r["length"]: r["count"] for r in d.groupBy("length").count().collect()}  # noqa: E731  as many as there are lengths
    long_x = of_length(x)
    long_y = of_length(y) if both_tables else long_x
    all_pairs = sum(n * long_y.get(k + d, 0) for k, n in long_x.items() for d in range(-t, t + 1)) // (1 if both_tables else 2)
    if not all_pairs:  # nothing of like length
        return x.select(F.col("core").alias("core_i"), F.col("core").alias("core_p"), F.lit(0.0).alias("sim")).limit(0)

    def index(rows: DataFrame) -> DataFrame:
        return rows.select("core", "length", F.explode(segments(F.col("part"), F.col("length"), t)).alias("s")).select(F.col("core").alias("core_i"), F.col("length").alias("length_i"), F.col("s.nr").alias("nr"), F.col("s.segment").alias("segment"))

    def probe(rows: DataFrame, below: int, above: int) -> DataFrame:
        """Substrings that could be a segment of an indexed text at most ``below`` shorter or ``above`` longer."""
        n = t + 1

        def windows(other: Column) -> Column:
            """(length_i, nr, segment) of the windows for indexed texts of a length: made in the row, without copies of the text."""
            short, longer = F.floor(other / n).cast("int"), (other % n).cast("int")

            def of(nr: Column) -> Column:
                start = short * nr + F.greatest(F.lit(0), nr - (F.lit(n) - longer))
                size = short + F.when(nr >= F.lit(n) - longer, 1).otherwise(0)
                gap = F.col("length") - other
                lo = F.greatest(F.lit(0), start - nr, start + gap - (F.lit(t) - nr))
                hi = F.least(F.col("length") - size, start + nr, start + gap + (F.lit(t) - nr))
                at = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
                return F.transform(at, lambda i: F.struct(other.alias("length_i"), nr.alias("nr"), F.substring(F.col("part"), i + 1, size).alias("segment")))

            return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(t)), of))

        lengths = F.filter(F.sequence(F.col("length") - below, F.col("length") + above), lambda i: i >= 0)
        each = rows.select("core", "length", F.explode(F.array_distinct(F.flatten(F.transform(lengths, windows)))).alias("s"))
        return each.select(F.col("core").alias("core_p"), F.col("length").alias("length_p"), "s.length_i", "s.nr", "s.segment")

    place = ["nr", "segment", "length_i"]
    indexed, probed = index(x), probe(y, t, t if both_tables else 0)
    meets = all_pairs
    if all_pairs > _FEW_PAIRS:
        often = indexed.groupBy(place).agg(F.count("*").alias("n")).join(probed.groupBy(place).agg(F.count("*").alias("m")), place)
        meets = often.agg(F.sum(F.col("n") * F.col("m")).cast("double")).first()[0] or 0
    outright = meets >= all_pairs
    if outright:
        side = lambda d, s, n: d.select(F.col("core").alias(f"core_{s}"), F.col("length").alias(f"length_{s}")).repartition(n)
        parts = int(max(1, min(16, all_pairs // 200_000)))
        both = side(x, "i", parts).crossJoin(side(y, "p", parts)).filter(F.abs(F.col("length_i") - F.col("length_p")) <= t)
    else:
        both = indexed.join(probed, place)
    if not both_tables:
        both = both.filter("core_i < core_p" if outright else "core_i <> core_p AND (length_i < length_p OR core_i < core_p)")
    # checked where they meet: a pair that is no match is written nowhere
    near = both.withColumn("sim", F.levenshtein("core_i", "core_p", limit)).filter("sim >= 0").select("core_i", "core_p", F.col("sim").cast("double").alias("sim"))
    return near if outright else near.distinct()


def join(a: DataFrame, b: DataFrame | None = None, similarity_name: str = "jaccard", **options) -> DataFrame:
    """The prefix join, or the segment join for ``edit``."""
    if similarity_name.lower() in ("edit", "levenshtein"):
        return edit(a, b, **{k: v for k, v in options.items() if k not in ("weighted", "min_size")})
    return prefix(a, b, similarity_name=similarity_name, **options)


def block_pairs(df: DataFrame, block: list[str], id: str = "hash") -> DataFrame:
    """Unordered pairs of the rows that agree in all ``block`` columns."""
    left = df.select(F.col(id).alias("id_a"), *[F.col(c).alias(f"_{c}") for c in block])
    right = df.select(F.col(id).alias("id_b"), *[F.col(c).alias(f"r_{c}") for c in block])
    on = [F.col(f"_{c}") == F.col(f"r_{c}") for c in block]
    return left.join(right, on).filter("id_a < id_b").select("id_a", "id_b")


def by_schema(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The table under another one's column names (``names`` maps own to other), so that a join can take both; fails if a
    column is not mapped to one there is."""
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)} to map")
    return df.select(*[F.col(c).alias(n) for c, n in names.items()])


def pair_similarity(pairs: DataFrame, left: Column, right: Column, similarity_name: str, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Adds ``sim`` to pairs that carry the two texts."""
    tok = tokenizer or word()
    value = edit_distance(tok(left), tok(right)).cast("double") if similarity_name.lower() == "edit" else similarity(similarity_name, tok(left), tok(right))
    return pairs.withColumn("sim", value)
