"""Mixing sources by temperature, by DataFrame functions alone.

A source's share of all tokens, raised to an exponent between 0 (uniform) and 1 (as found), is its weight. The exponent is
bisected (four halvings a round): the largest that reaches a target entropy, but none so small that a source
would be repeated more than ``max_repeat`` times. Weights times a budget give each source tokens to draw; unless a budget is
given, it is the least that uses every document of every source once at least, so nothing is dropped.

A source is drawn in epochs. Its documents fall into blocks by a hash; an epoch is a permutation of the blocks and, in
each, of the documents. Whole epochs take all; the last takes blocks in order until the budget is used up, and only
the block in which that happens is sorted by document. So no task ever holds a source, however large, nor all its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import materialize

#: Intervals of one round of bisection (four halvings), and rounds.
PARTS, ROUNDS = 16, 8
#: Hashes are below this; blocks that one task puts in order, about.
PLACES, RUN = 1 << 48, 10_000


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_key() -> Column:
    """The doc_id, or a digest of the text where it is null."""
    return F.coalesce(F.col("doc_id").cast("string"), F.md5("text"))


def _hash(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 12), 16, 10).cast("long")


def _bisect(shares: DataFrame, holds: Column, up: bool) -> float:
    """Largest (``up``) or smallest exponent for which the aggregate ``holds``; it does at 0 (``up``) or at 1."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / PARTS for i in range(PARTS + 1)]
        tried = shares.select("p", F.posexplode(F.array(*[F.lit(g) for g in grid])).alias("i", "x")).withColumn("w", F.pow("p", "x"))
        ok = {r.i for r in tried.groupBy("i").agg(holds.alias("ok")).filter("ok").collect()}
        if up:
            i = max((i for i in ok if i < PARTS), default=0)
            if PARTS in ok:
                return hi
        else:
            i = min((i for i in ok if i > 0), default=PARTS) - 1
            if 0 in ok:
                return lo
        lo, hi = grid[i], grid[i + 1]
    return lo if up else hi


def exponent(sizes: DataFrame, target_entropy: float | None, max_repeat: float | None, budget_tokens: float | None = None) -> float:
    """The exponent for sources of ``tokens``. ``target_entropy`` is a share of the largest, the logarithm of their number.

    With a repetition limit alone, the sources are as even as the limit allows.
    """
    filled = sizes.filter("tokens > 0")
    total = filled.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total.n or total.n == 1:
        return 1.0
    shares = materialize(filled.select((F.col("tokens") / F.lit(float(total.t))).alias("p")), "shares")
    out = 1.0 if max_repeat is None else 0.0
    if target_entropy is not None:
        entropy = F.log(F.sum("w")) - F.sum(F.col("w") * F.log("w")) / F.sum("w")
        out = _bisect(shares, entropy >= F.lit(min(1.0, target_entropy) * math.log(total.n) - 1e-12), True)
    if max_repeat is not None:
        budget = F.max(F.col("p") / F.col("w")) if budget_tokens is None else F.lit(budget_tokens / float(total.t)) / F.sum("w")
        out = max(out, _bisect(shares, F.max(F.col("w") / F.col("p")) * budget <= F.lit(max_repeat), False))
    return round(out, 6)


def budgets(sizes: DataFrame, x: float, budget_tokens: float | None = None) -> DataFrame:
    """source, weight and budget (tokens to draw) of each source of ``sizes`` (source, docs, tokens)."""
    total = sizes.agg(F.sum("tokens").cast("double").alias("t")).first().t or 1.0
    raw = sizes.withColumn("raw", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(total), F.lit(x))).otherwise(0.0))
    sums = raw.agg(F.sum("raw").alias("z"), F.max(F.when(F.col("raw") > 0, F.col("tokens") / F.col("raw"))).alias("once")).first()
    z, once = sums.z or 1.0, sums.once or 0.0
    unit = once if budget_tokens is None else budget_tokens / z
    return raw.select("source", "docs", "tokens", (F.col("raw") / F.lit(z)).alias("weight"), F.round(F.col("raw") * F.lit(unit)).cast("long").alias("budget"))


def mix(docs: DataFrame, tokens: Column, target_entropy: float | None = 0.9, max_repeat: float | None = 1.5, budget_tokens: float | None = None, block_rows: int = 2000, key: str | Column = "doc_id", source: str = "source", prefix: str = "") -> DataFrame:
    """``docs`` as drawn, each row once per epoch, with n_tokens, weight, epoch, block and block_rank (from 0 in source and epoch).

    A null source is a source. A source without tokens is drawn once. Rows with equal keys, or with null ones, share a block and
    are drawn alike: where many keys may be null, ``key`` should be a column that falls back to another, as ``text_key`` does. Result columns get ``prefix``; columns of ``docs`` stay, whatever their names, but for one that has a
    result's name. An empty table gives an empty result.
    """
    names = {n: f"{prefix}{n}" for n in ("n_tokens", "weight", "epoch", "block", "block_rank")}
    # columns go by their places meanwhile, so that no name can meet one made here
    given = [f"c{i}" for i in range(len(docs.columns))]
    of_row = docs[key] if isinstance(key, str) else key
    counted = docs.select("*", tokens.alias("_tokens"), F.coalesce(of_row.cast("string"), F.lit("")).alias("_key")).toDF(*given, "_tokens", "_key")
    source, key_text = given[docs.columns.index(source)], F.col("_key")
    sizes = materialize(counted.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"), F.sum("_tokens").alias("tokens")), "sizes")
    plan = materialize(budgets(sizes, exponent(sizes, target_entropy, max_repeat, budget_tokens), budget_tokens).withColumn("blocks", F.ceil(F.col("docs") / F.lit(block_rows)).cast("long")), "budgets")
    of = plan.select(F.col("source").alias("_source"), F.col("blocks").alias("_blocks"))
    cut = counted.join(of, counted[source].eqNullSafe(of["_source"])).withColumn("_block", F.pmod(_hash(F.lit("block"), key_text), F.col("_blocks")))
    sums = materialize(cut.groupBy("_source", "_block").agg(F.sum("_tokens").alias("in_block")), "blocks")
    per = sums.join(plan, sums["_source"].eqNullSafe(plan["source"]))
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1)
    per = per.withColumn("whole", whole.cast("long")).withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("whole") * F.col("tokens")).otherwise(0))
    drawn = per.withColumn("epoch", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("whole")), lambda e: (e < F.col("whole")) | (F.col("rest") > 0))))
    # a source's blocks are put in order in two levels: runs of places of about ``RUN`` blocks, then the blocks of a run
    width = F.ceil(F.lit(float(PLACES)) / F.ceil(F.col("blocks") / F.lit(RUN)))
    dealt = drawn.withColumn("place", _hash(F.lit("rank"), F.col("epoch").cast("string"), F.col("_block").cast("string"))).withColumn("run", F.floor(F.col("place") / width))
    earlier = Window.partitionBy("_source", "epoch").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = dealt.groupBy("_source", "epoch", "run").agg(F.count("*").alias("n"), F.sum("in_block").alias("held"))
    runs = runs.select(F.col("_source").alias("s"), F.col("epoch").alias("e"), F.col("run").alias("r"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "held")])
    order = Window.partitionBy("_source", "epoch", "run").orderBy("place", "_block")
    placed = dealt.join(runs, dealt["_source"].eqNullSafe(runs["s"]) & (dealt["epoch"] == runs["e"]) & (dealt["run"] == runs["r"]))
    ranked = placed.withColumn("rank", F.col("n_before") + F.row_number().over(order) - 1).withColumn("before", F.col("held_before") + F.coalesce(F.sum("in_block").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    left = F.when(F.col("epoch") < F.col("whole"), F.lit(None).cast("long")).otherwise(F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    # how many tokens of a block an epoch takes: null is all of them
    turns = ranked.withColumn("take", F.when(left < F.col("in_block"), left)).filter("take IS NULL OR take > 0")
    turns = materialize(turns.select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), F.col("epoch").alias("_epoch"), F.col("rank").cast("long").alias("_rank"), F.col("weight").alias("_weight"), F.col("take").alias("_take")), "turns")
    met = cut.join(turns, cut["_source"].eqNullSafe(turns["_s"]) & (cut["_block"] == turns["_b"]))
    run = Window.partitionBy("_source", "_block", "_epoch").orderBy(_hash(F.lit("doc"), F.col("_epoch").cast("string"), key_text), key_text, F.col("_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    part = met.filter("_take IS NOT NULL").withColumn("_before", F.coalesce(F.sum("_tokens").over(run), F.lit(0))).filter("_before < _take").drop("_before")
    out = met.filter("_take IS NULL").unionByName(part)
    shown = [F.col("_tokens").alias(names["n_tokens"]), F.col("_weight").alias(names["weight"]), F.col("_epoch").alias(names["epoch"]), F.col("_block").alias(names["block"]), F.col("_rank").alias(names["block_rank"])]
    taken = {n.lower() for n in names.values()}
    return out.select(*[F.col(c).alias(name) for c, name in zip(given, docs.columns, strict=True) if name.lower() not in taken], *shown)
