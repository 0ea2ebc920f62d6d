"""Mixing sources by temperature.

A source's weight is its token share to the power of an exponent, normalised. The exponent is
bisected, many cuts at a time over the table of shares, until the weights have a wanted entropy
or the most repeated source meets a repetition limit. Every source then gets a token budget,
which is realised by permutations of hashed blocks: whole epochs first, each in an order of its
own, then blocks of one more epoch until the budget is spent, and rows of the last block.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowloom.llm.base import quoted, text_or_empty
from flowloom.operators.ordered import running_totals
from flowloom.workspace import checked_broadcast, materialize

CUTS = 16
ROUNDS = 8
BLOCK_TOKENS = 200_000
WHOLE = (1 << 63) - 1
ADDED = ("mix_epoch", "mix_position", "mix_order", "mix_tokens")


@dataclass(frozen=True)
class Target:
    """What the exponent has to meet. ``repetitions``: the smallest exponent from 0 to 1 at which
    no source is repeated more often. ``entropy``: that of the weights, as a share of the greatest
    possible. ``budget``: tokens to draw; by default as many as give the largest source one pass,
    so that every row is drawn at least once."""

    repetitions: float | None = 2.0
    entropy: float | None = None
    budget: int | None = None


def count_words(text: Column) -> Column:
    """Tokens of a text: its runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("bigint")


def _at(exponents: list[float], target: Target) -> list[Column]:
    """For every exponent, what is compared with the target; it falls as the exponent grows."""
    found = []
    share = F.col("share")
    for a in exponents:
        weight = F.pow(share, F.lit(a))
        if target.entropy is not None:
            z = F.sum(weight)
            found.append((F.log(z) - a * F.sum(weight * F.log(share)) / z) / F.greatest(F.log(F.count("*").cast("double")), F.lit(1e-12)))
        elif target.budget is None:
            found.append(F.max(F.pow(share, F.lit(a - 1))))
        else:
            found.append(F.max(weight / F.col("tokens")) * target.budget / F.sum(weight))
    return found


def find_exponent(shares: DataFrame, target: Target) -> float:
    """The exponent for ``shares``: one row per source with ``tokens`` > 0 and ``share``, tokens
    over those of the largest source. A target out of reach gives the nearer end of the range:
    0 to 1 for repetitions, 0 to 64 for entropy."""
    low, high = 0.0, 64.0 if target.entropy is not None else 1.0
    wanted = target.entropy if target.entropy is not None else target.repetitions
    for _ in range(ROUNDS):
        marks = [low + (high - low) * k / CUTS for k in range(CUTS + 1)]
        values = shares.agg(*[v.alias(f"v{k}") for k, v in enumerate(_at(marks, target))]).first()
        if values[0] is None or values[0] <= wanted:
            return low
        if values[CUTS] > wanted:
            return high
        k = next(k for k, v in enumerate(values) if v <= wanted)
        low, high = marks[k - 1], marks[k]
    return high


def _source(name: str) -> Column:
    """A source's name; a null source is one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def mixture(
    docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block_tokens: int = BLOCK_TOKENS, seed: int = 0, columns: list[str] | None = None,
) -> DataFrame:
    """``columns`` (by default all) of every drawn row, once per draw, with ``mix_epoch``,
    ``mix_position`` (how far its source's budget is spent where its block begins, 0 to 1: the
    order that interleaves sources by weight), ``mix_order`` (order in the block) and
    ``mix_tokens``. Columns of ``docs`` with these names are left out.

    Rows with equal id and text are drawn together. Null texts have no tokens; they cost nothing
    and are drawn with their block. A source without any token has no weight; its rows are drawn
    once. An empty table gives an empty result. A budget is passed by less than one row.
    """
    source, text = _source(source_col), text_or_empty(text_col)
    row = F.xxhash64(F.lit(seed), F.col(id_col), text)
    sizes = materialize(
        docs.select(source.alias("_src"), row.alias("_row"), count_words(text).alias("_tok")), "row-sizes"
    )
    totals = sizes.groupBy("_src").agg(F.sum("_tok").alias("tokens"))
    most = totals.agg(F.max("tokens")).first()[0]
    shares = materialize(totals.withColumn("share", F.col("tokens") / F.lit(float(most or 1))), "shares")
    real = shares.where(F.col("tokens") > 0)
    a = find_exponent(real, target)
    z = real.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    budget = float(most or 0) * z if target.budget is None else float(target.budget)
    # How often a source's tokens fit in its budget.
    passes = F.pow("share", F.lit(a)) / F.lit(z) * F.lit(budget) / F.col("tokens")
    passes = F.when(F.col("tokens") > 0, F.greatest(passes, F.lit(0.0))).otherwise(F.lit(1.0))
    near = F.round(passes)
    passes = F.when(F.abs(passes - near) < 1e-9, near).otherwise(passes)
    plan = checked_broadcast(
        shares.select(
            F.col("_src").alias("_psrc"), F.col("tokens").alias("_total"), passes.alias("_passes"),
            F.greatest(F.ceil(F.col("tokens") / F.lit(block_tokens)), F.lit(1)).alias("_blocks"),
        ),
        "source-plan",
    )
    block = F.pmod(F.col("_row"), F.col("_blocks"))
    blocks = sizes.join(plan, F.col("_src") == F.col("_psrc")).groupBy("_src", block.alias("_block")).agg(
        F.sum("_tok").alias("_tok"), F.first("_passes").alias("_passes"), F.first("_total").alias("_total")
    )
    epochs = blocks.withColumn(
        "mix_epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("_passes") - 1, F.lit(0)).cast("int")))
    ).where(F.col("mix_epoch") < F.col("_passes"))
    order = F.xxhash64(F.lit(seed), "_block", "mix_epoch")
    lined = running_totals(epochs, ["_src", "mix_epoch"], [order, F.col("_block")], {"_tok": F.col("_tok")})
    # What is left of the budget in this epoch; whole epochs have no end.
    last = F.col("mix_epoch") + 1 > F.col("_passes")
    left = F.when(last, (F.col("_passes") - F.col("mix_epoch")) * F.col("_total"))
    drawn = materialize(
        lined.withColumn("_left", left - F.col("_tok_before"))
        .where(F.col("_left").isNull() | (F.col("_left") > 0))
        .withColumn("mix_position", (F.col("mix_epoch") + F.col("_tok_before") / F.greatest("_total", F.lit(1))) / F.col("_passes"))
        .select("_src", "_block", "mix_epoch", "mix_position", F.when(F.col("_left") < F.col("_tok"), F.col("_left")).alias("_left")),
        "drawn-blocks",
    )
    # The block of each source in which its budget ends: rows in order until it is spent.
    cut = drawn.where(F.col("_left").isNotNull())
    member = sizes.join(plan, F.col("_src") == F.col("_psrc")).select("_src", block.alias("_block"), "_row", "_tok").join(
        cut.select("_src", "_block", "mix_epoch", "_left"), ["_src", "_block"]
    ).withColumn("_key", F.xxhash64("_row", "mix_epoch"))
    before = Window.partitionBy("_src", "_block", "mix_epoch").orderBy("_key").rangeBetween(Window.unboundedPreceding, -1)
    ends = (
        member.groupBy("_src", "_block", "mix_epoch", "_left", "_key").agg(F.sum("_tok").alias("_tok"))
        .withColumn("_before", F.coalesce(F.sum("_tok").over(before), F.lit(0)))
        .where(F.col("_before") < F.col("_left"))
        .groupBy("_src", "_block", "mix_epoch").agg(F.max("_key").alias("_upto"))
    )
    draws = materialize(
        drawn.join(ends, ["_src", "_block", "mix_epoch"], "left").select(
            F.col("_src").alias("_dsrc"), F.col("_block").alias("_dblock"), "mix_epoch", "mix_position",
            F.coalesce("_upto", F.when(F.col("_left").isNull(), F.lit(WHOLE))).alias("_upto"),
        ),
        "draws",
    )
    names = [c for c in columns or docs.columns if c not in ADDED]
    rows = docs.select(
        F.struct(*map(quoted, names)).alias("_all"), source.alias("_src"), row.alias("_row"), count_words(text).alias("mix_tokens")
    ).join(plan, F.col("_src") == F.col("_psrc")).withColumn("_block", block).drop("_psrc", "_total", "_passes", "_blocks")
    key = F.xxhash64("_row", "mix_epoch")
    return rows.join(draws, (F.col("_src") == F.col("_dsrc")) & (F.col("_block") == F.col("_dblock"))).where(
        key <= F.col("_upto")
    ).select("_all.*", "mix_epoch", "mix_position", key.alias("mix_order"), "mix_tokens")
