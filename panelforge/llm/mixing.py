"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed into cells of source, language and topic. The cells' token weights are raked:
scaled to the target sums of sources, then of languages, then of topics, again and again, where a
cell counts with no more than the tokens it has, until the sums of what counts meet their targets.
What counts of a cell, by its tokens, is the probability by which its documents are sampled, each
by a hash of its id; so the expected sample has the target sums. Built-in functions only.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Rounds, fresh, is_small, saved, text_of

DIMENSIONS = ("source", "lang", "topic")
#: A value's target share is its share of tokens to this power, made to sum to 1: below 1 it evens out.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS_AT_ONCE = 10  # rounds over few cells between two looks at the error
PATIENCE = 3  # looks without progress, after which targets count as infeasible


def tokens_of(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """What kind of text it is by its form: table, numeric, list or prose."""
    size = F.length(text)
    bars = size - F.length(F.replace(text, F.lit("|"), F.lit("")))
    digits = F.regexp_count(text, F.lit("[0-9]"))
    breaks = size - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(bars * 50 > size, "table").when(digits * 25 > size, "numeric").when(size < 60 * (breaks + 1), "list").otherwise("prose")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) for each key, by MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _wanted(cells: DataFrame, dimension: str, power: float, given: DataFrame | None) -> DataFrame:
    """value, available, share: tokens and target share of each value of one dimension."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("n").cast("double").alias("available"))
    if given is None:
        wanted = sums.select("value", "available", F.pow("available", F.lit(power)).alias("w"))
    else:
        shares = given.groupBy(F.col("value").alias("_v")).agg(F.sum("share").cast("double").alias("w"))
        wanted = sums.join(shares, F.col("value").eqNullSafe(F.col("_v")), "left").select("value", "available", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w"))
    total = wanted.agg(F.sum("w")).first()[0] or 1.0
    return saved(wanted.select("value", "available", (F.col("w") / total).alias("share")))


def _capped(wanted: DataFrame, total: float) -> DataFrame:
    """`wanted` with target: `total` tokens by share, where a value has no more than its tokens and the others make up for it."""
    level = total
    while True:
        full = F.col("available") <= F.col("share") * level
        got = wanted.where("share > 0").agg(F.sum(F.when(full, F.col("available"))), F.sum(F.when(~full, F.col("share")))).first()
        after = max((total - (got[0] or 0.0)) / got[1], level) if got[1] else level
        if after == level:
            return saved(wanted.withColumn("target", F.least("available", F.col("share") * level)))
        level = after


def rake(
    cells: DataFrame,
    *,
    keep: float = 0.5,
    powers: dict[str, float] = POWERS,
    given: dict[str, DataFrame] | None = None,
    tolerance: float = 1e-9,
    max_rounds: int = 500,
    broadcast_cells: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """`cells` (source, lang, topic, n tokens) with x, the tokens wanted of each, at most n; and the marginals.

    x sums to `keep` of all tokens. The marginals (dimension, value, available, wanted, target,
    expected) say what a value has, what its share of the sample would be, that or all it has with
    what others lack made up for, and what x gives it. `given` can hold target shares (value, share)
    of a dimension; values it doesn't name get none. Rounds go on until every sum is within
    `tolerance` of its target, relatively; if many rounds haven't brought the largest error down
    by a hundredth, or after `max_rounds`, no weights meet the targets together, as where the cells
    between them are empty, and what is left is in the marginals and in a warning. At most
    `broadcast_cells` cells are raked as one small partition, several rounds a plan; more are raked
    as they lie, their sums aggregated before they are shuffled, a round a plan.
    """
    given = given or {}
    cells = saved(cells.where("n > 0"))
    one_task = is_small(cells, broadcast_cells)
    cells = cells.coalesce(1) if one_task else cells  # few cells need no exchanges
    everything = float(cells.agg(F.sum("n")).first()[0] or 0)
    wanted = {d: _wanted(cells, d, powers.get(d, 1.0), given.get(d)) for d in DIMENSIONS}
    within = [w.where("share > 0").agg(F.sum("available")).first()[0] or 0.0 for w in wanted.values()]
    total = min(keep * everything, *within)
    targets = {d: _capped(w, total) for d, w in wanted.items()}
    small = {d: is_small(targets[d], broadcast_cells) for d in DIMENSIONS}
    for d in DIMENSIONS:
        own = targets[d].select(F.col("value").alias("_v"), F.col("target").alias(f"t_{d}"))
        cells = cells.join(F.broadcast(own) if small[d] else own, F.col(d).eqNullSafe(F.col("_v"))).drop("_v")
    # y is the raked weight; x, what counts of it, is cut at the cell's tokens
    x, open_y = F.least("n", "y"), F.when(F.col("y") < F.col("n"), F.col("y")).otherwise(0.0)

    def with_sums(rows: DataFrame, d: str) -> DataFrame:
        if one_task:
            return rows.withColumns({"_x": F.sum(x).over(Window.partitionBy(d)), "_open": F.sum(open_y).over(Window.partitionBy(d))})
        sums = rows.groupBy(F.col(d).alias("_v")).agg(F.sum(x).alias("_x"), F.sum(open_y).alias("_open"))
        return rows.join(F.broadcast(sums) if small[d] else sums, F.col(d).eqNullSafe(F.col("_v"))).drop("_v")

    loop = Rounds(cells.sparkSession)
    fitted = loop.write(cells.withColumn("y", F.col("n") * keep))
    errors: list[float] = []
    for _ in range(max_rounds):
        if one_task:
            fitted = fitted.coalesce(1)  # so that no window needs an exchange
        for _ in range(ROUNDS_AT_ONCE if one_task else 1):
            fitted = fitted.withColumn("off", F.lit(0.0))
            for d in DIMENSIONS:
                fitted, target = with_sums(fitted, d), F.col(f"t_{d}")
                # what lacks is put on what isn't cut; what is too much is taken from all
                short = target > F.col("_x")
                factor = F.when(short & (F.col("_open") > 0), 1 + (target - F.col("_x")) / F.col("_open")).when(~short & (F.col("_x") > 0), target / F.col("_x")).otherwise(1.0)
                error = F.when(target > 0, F.abs(F.col("_x") / target - 1)).when(F.col("_x") > 0, 1.0).otherwise(0.0)
                fitted = fitted.withColumns({"y": F.col("y") * factor, "off": F.greatest("off", error)}).drop("_x", "_open")
        written = loop.write(fitted)
        errors.append(written.agg(F.max("off")).first()[0] or 0.0)
        fitted = written.drop("off")
        if errors[-1] <= tolerance or len(errors) > PATIENCE and errors[-1] > 0.99 * errors[-1 - PATIENCE]:
            break
    fitted = fitted.select(*DIMENSIONS, "n", x.alias("x"))
    report = reduce(DataFrame.unionByName, [
        targets[d].join(fitted.groupBy(F.col(d).alias("_v")).agg(F.sum("x").alias("expected")), F.col("value").eqNullSafe(F.col("_v")))
        .select(F.lit(d).alias("dimension"), F.col("value").cast("string").alias("value"), "available", (F.col("share") * total).alias("wanted"), "target", "expected")
        for d in DIMENSIONS
    ])
    if errors[-1] > tolerance:
        warnings.warn(f"mixing: a marginal is off its target by {errors[-1]:.2%}; the targets may not be feasible together", stacklevel=2)
    return fitted, report


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    keep: float = 0.5,
    powers: dict[str, float] = POWERS,
    given: dict[str, DataFrame] | None = None,
    seed: int = 17,
    broadcast_cells: int = 100_000,
) -> DataFrame:
    """`docs` with topic, n_tokens, rate, probability and sampled.

    `keep` is the share of all tokens that the sample has in expectation; a document's rate is its
    probability by that. The topic is what `topic` says of the columns, else the text's form
    (topic_of()). Targets that can't be met are reported as rake() says. Nulls in source, lang or
    topic are a value of their own. Null, empty and blank texts have no tokens: rate 0, never
    sampled. Rows of one id are sampled together. An empty table gives an empty result; columns
    named like the new ones are replaced. Cells are broadcast to the documents only if they number
    at most `broadcast_cells`.
    """
    text = text_of(text_col)
    named = docs.withColumns({"topic": topic_of(text) if topic is None else topic, "n_tokens": tokens_of(text)}).drop("rate", "probability", "sampled")
    kept = [c for c in docs.columns if c.lower() not in ("topic", "n_tokens", "rate", "probability", "sampled")]
    cells, _ = rake(named.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")), keep=keep, powers=powers, given=given, broadcast_cells=broadcast_cells)
    keys = {d: fresh(f"cell_{d}", named) for d in DIMENSIONS}
    p = fresh("p", named)
    table = cells.select(*[F.col(d).alias(keys[d]) for d in DIMENSIONS], (F.col("x") / F.col("n")).alias(p))
    table = F.broadcast(table) if is_small(table, broadcast_cells) else table
    same = [named[d].eqNullSafe(table[keys[d]]) for d in DIMENSIONS]
    probability = F.coalesce(F.when(F.col("n_tokens") > 0, F.col(p)), F.lit(0.0))
    return named.join(table, same[0] & same[1] & same[2], "left").select(
        *kept, "topic", "n_tokens", (probability / keep).alias("rate"), probability.alias("probability"),
        F.coalesce(unit_hash(F.col(id_col), seed) < probability, F.lit(False)).alias("sampled"),
    )
