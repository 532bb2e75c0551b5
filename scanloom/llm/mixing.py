"""Mixing sources to target weights, by temperature: DataFrame functions only.

With token shares p the weights are p^a / sum p^a. The exponent a is bisected so
that the weights reach a target entropy and no source is repeated more often than
allowed. The weights are then realised as budgeted block permutations: every
epoch of a source is a fresh random order of its blocks and of the documents in
them, cut where the source's token budget ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.session import cut

#: Share of the largest possible entropy (log of the number of sources) that the mix has at least, if repetition allows.
ENTROPY = 0.95
#: Most epochs of any source.
REPEATS = 4.0
#: Documents of one block, about.
BLOCK_DOCS = 256
#: Stretches of turns are told by so many hexadecimal digits: 4,096 of them.
PART_DIGITS = 3
#: Rounds of bisection; the exponent is a multiple of 2^-ROUNDS.
ROUNDS = 24
#: Rounds that one job evaluates at once.
STEP = 4
WORD = r"[^\x20\x09-\x0D]+"


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_tokens``: the words of the whole text (null: none)."""
    return docs.withColumn("n_tokens", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))


def source_sizes(counted: DataFrame, source: str = "source") -> DataFrame:
    """One row per source, null its own: ``source, docs, tokens``."""
    return counted.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))


def exponent(sizes: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """The largest exponent in [0, 1] whose mix has ``entropy``, raised where a source would come more than ``repeats`` times.

    Weights flatten as the exponent falls: entropy and repetition both grow. Each
    round is one small aggregation over the sources that returns a single row for
    all midpoints the next STEP halvings can meet.
    """
    live = cut(sizes.where("tokens > 0").select(F.col("tokens").cast("double").alias("t")))
    top = live.agg(F.max("t"), F.min("t"), F.sum("t"), F.count("*")).first()
    if not top[3]:
        return 1.0
    biggest, smallest, total, n = top
    if n == 1:
        return 1.0

    def entropies(points: list[float]) -> list[float]:
        share = F.col("t") / F.lit(total)
        cols = []
        for a in points:
            p = F.pow(share, F.lit(a))
            cols += [F.sum(p), F.sum(p * F.ln(p))]
        row = live.agg(*cols).first()
        return [_entropy(row[2 * i], row[2 * i + 1]) for i in range(len(points))]

    def _entropy(s: float, plogp: float) -> float:
        import math

        return math.log(s) - plogp / s

    import math

    target = entropy * math.log(n)
    low, high = 0, 1 << ROUNDS
    if entropies([1.0])[0] >= target:
        low = high
    while high - low > 1:
        step = max(1, (high - low) >> STEP)
        points = list(range(low + step, high, step))
        found = entropies([p / (1 << ROUNDS) for p in points])
        passed = [p for p, h in zip(points, found, strict=True) if h >= target]
        low = max(passed, default=low)
        high = min([p for p in points if p > low], default=high)
    by_entropy = low / (1 << ROUNDS)
    # Repetition in epochs against the largest source is (smallest / biggest)^(a - 1).
    lo, hi = 0, 1 << ROUNDS
    if smallest < biggest:
        if math.pow(smallest / biggest, -1.0) <= repeats:
            hi = 0
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if math.pow(smallest / biggest, mid / (1 << ROUNDS) - 1) <= repeats else (mid, hi)
        by_repeats = hi / (1 << ROUNDS)
    else:
        by_repeats = 0.0
    return max(by_entropy, by_repeats)


def budgets(sizes: DataFrame, a: float, budget: float | None = None) -> DataFrame:
    """Add ``weight, quota`` to the sources. budget: tokens of the mix; None: the
    fewest with which every document of every source comes at least once.

    A source without tokens has weight null and a quota that takes it once.
    """
    t = F.col("tokens").cast("double")
    norm, widest = sizes.where("tokens > 0").agg(F.sum(F.pow(t, F.lit(a))), F.max(F.pow(t, F.lit(1.0 - a)))).first()
    whole = (widest or 0.0) * (norm or 0.0) if budget is None else float(budget)
    weight = F.when(F.col("tokens") > 0, F.pow(t, F.lit(a)) / F.lit(norm or 1.0))
    quota = F.coalesce(F.floor(F.col("weight") * F.lit(whole) + F.lit(1e-6)), F.lit(0)).cast("long")
    # Without a budget every source comes whole at least once, whatever the last bit of the product is.
    return sizes.withColumn("weight", weight).withColumn("quota", quota if budget is not None else F.greatest(quota, "tokens"))


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``key, source, n_tokens, epoch, block, start`` of every place in the mix.

    A document comes in epoch e if its source's stream (epoch after epoch, blocks
    in random order, documents in random order within their block) reaches it
    before the source's quota is spent, and always in the first epoch if there is no
    budget; start is its place in that stream, in tokens. Blocks are dealt by hash, so one source with a third of all rows is many
    blocks; their totals are summed in two levels, so no source is ordered in one task. Null sources are one source,
    documents without words come where the stream passes them, sources
    without words come once, repeated rows are documents of their own (in order of
    their length where they share a key), a very long text is one number, other columns are ignored.
    """
    counted = cut(token_counts(docs, text).select(F.col(key).alias("key"), F.col(source).alias("source"), "n_tokens"))
    sizes = cut(source_sizes(counted))
    plan = budgets(sizes, exponent(sizes, entropy, repeats), budget)
    # One row per source and epoch, with the tokens that the epoch may still give.
    epochs = F.when(F.col("tokens") > 0, F.greatest(F.lit(1), F.ceil(F.col("quota") / F.col("tokens")))).otherwise(F.lit(1)).cast("int")
    plan = plan.withColumn("blocks", F.ceil(F.col("docs") / F.lit(block_docs)).cast("long"))
    plan = cut(plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1))).withColumn("left", F.col("quota") - F.col("epoch") * F.col("tokens")))
    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    per_source = plan.where("epoch = 0").select("source", "blocks")
    block = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit("-")))), 1, 8), 16, 10).cast("long"), F.col("blocks"))
    dealt = cut(counted.alias("d").join(per_source.alias("p"), same).select("key", "d.source", "n_tokens", block.alias("block")))
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    turns = blocks.alias("d").join(plan.alias("p"), same).select("d.source", "block", "block_tokens", "epoch", "tokens", "left")
    turns = turns.withColumn("turn", F.md5(F.concat_ws("|", F.lit(seed), "epoch", name, "block")))
    # Blocks of one stretch of turns follow each other: the stretches of a source and epoch are summed first, then the blocks inside.
    turns = cut(turns.withColumn("part", F.substring("turn", 1, PART_DIGITS)))
    w = Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = turns.groupBy("source", "epoch", "part").agg(F.sum("block_tokens").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))
    w = Window.partitionBy("source", "epoch", "part").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("inside", F.coalesce(F.sum("block_tokens").over(w), F.lit(0)))
    where = same & (F.col("d.epoch") == F.col("p.epoch")) & (F.col("d.part") == F.col("p.part"))
    turns = turns.alias("d").join(parts.alias("p"), where).select("d.source", "block", "d.epoch", "tokens", "left", (F.col("base") + F.col("inside")).alias("before"))
    first = (F.col("epoch") == 0) & (F.lit(budget is None) | (F.col("tokens") == 0))
    turns = turns.where((F.col("before") < F.col("left")) | first)
    both = F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.block") == F.col("t.block"))
    placed = dealt.alias("d").join(turns.alias("t"), both).select("key", "d.source", "n_tokens", "epoch", "d.block", "tokens", "left", "before")
    order = F.md5(F.concat_ws("|", F.lit(seed), "epoch", F.coalesce(F.col("key").cast("string"), F.lit("-"))))
    w = Window.partitionBy("source", "block", "epoch").orderBy(order, "key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    placed = placed.where((F.col("at") < F.col("left")) | first)
    return placed.select(F.col("key").alias(key), F.col("source").alias(source), "n_tokens", "epoch", "block", (F.col("epoch") * F.col("tokens") + F.col("at")).alias("start"))
