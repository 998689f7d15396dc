"""Quality rules: learned decision lists over text statistics, as ordered Spark conditions.

Sequential covering: rules are conjunctions of `statistic <= x` or `statistic >= x` that reject a
text. Each is grown condition by condition on one part of a labelled sample (largest FOIL gain),
pruned on the other, and kept if it is precise there; what it covers is set aside before the next
is grown. Counts come from grouped aggregation over (statistic, bin); the driver sees only those
few hundred counts. The list becomes one `CASE WHEN` expression. Built-in functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bind, saved, text_of

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: What rules may test; each a rate or a size that doesn't depend on the corpus.
STATISTICS = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "mark_rate", "digit_rate", "long_word_rate"]


@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.statistic)
        return value >= self.threshold if self.at_least else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float

    def column(self) -> Column:
        return reduce(Column.__and__, (c.column() for c in self.conditions))

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _count(text: Column, of: str) -> Column:
    """How many characters of the class `of` the text has."""
    return F.length(F.regexp_replace(text, f"[^{of}]+", "")).cast("long")


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more, each word once."""
    def of_windows(windows: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            last = F.size(s) - 1
            same = lambda x, i: x["h"] == F.get(s, i)["h"]
            twice = F.filter(s, lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce((i < last) & same(x, i + 1), F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        keyed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(bind(F.sort_array(keyed), of_sorted))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda a, i: F.xxhash64(a, F.get(h, i + 1), F.get(h, i + 2)))
        return bind(windows, of_windows)

    return bind(F.transform(words, lambda w: F.xxhash64(w)), of_hashes).cast("long")


def with_statistics(docs: DataFrame, text_col: str = "text", *, repeats: bool = True) -> DataFrame:
    """`docs` with the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and STATISTICS.

    Words are runs of characters other than space and \\t to \\r. Without words, the rates are 0.
    Equal 3-word windows are found by 64-bit hashes; without `repeats` they aren't sought and count as none.
    """
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    words = F.array_remove(F.split(text, SPACE), "")
    counted = docs.withColumn(
        "_w",
        bind(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(F.filter(w, lambda x: F.length(x) > 20)).cast("long").alias("n_long_words"),
            (_repeated(w) if repeats else F.lit(0).cast("long")).alias("n_repeat_words"),
        )),
    ).withColumn(
        "_l", bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    )
    return (
        counted.select(
            *docs.columns, "_w.*", "_l.*",
            F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            _count(text, SYMBOLS).alias("n_symbols"), _count(text, r"\p{Lu}").alias("_upper"), _count(text, r"!?").alias("_marks"), _count(text, r"0-9").alias("_digits"),
        )
        .withColumns({
            "mean_word": rate("word_chars", "n_words"), "symbol_rate": rate("n_symbols", "word_chars"), "dup_line_rate": rate("n_dup_lines", "n_lines"),
            "repeat_rate": rate("n_repeat_words", "n_words"), "distinct_rate": rate("n_distinct", "n_words"), "upper_rate": rate("_upper", "word_chars"),
            "mark_rate": rate("_marks", "word_chars"), "digit_rate": rate("_digits", "word_chars"), "long_word_rate": rate("n_long_words", "n_words"),
        })
        .drop("_upper", "_marks", "_digits")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn_rules(
    sample: DataFrame,
    *,
    label_col: str = "rejected",
    id_col: str = "doc_id",
    bins: int = 24,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.97,
    min_covered: int = 10,
) -> list[Rule]:
    """A decision list from labelled statistics (`label_col`: 1 to reject, 0 to keep).

    A rule stands if it is at least `min_precision` precise on the pruning part and covers
    `min_covered` rejected rows of both parts together; a sample that is empty or has one label
    alone gives an empty list, which rejects nothing. Rows with a null label, and nulls among the
    statistics, fit no rule. Thresholds are the sample's quantiles, so equal samples give equal rules.
    """
    sample = saved(sample.where(F.col(label_col).isNotNull()).select(
        *[F.col(x).cast("double").alias(x) for x in STATISTICS], (F.col(label_col) == 1).alias("_y"),
        (F.pmod(F.xxhash64(id_col), F.lit(3)) < 2).alias("_grow"),
    ))
    steps = [i / bins for i in range(1, bins)]
    cuts_of = sample.groupBy("_y").agg(*[F.percentile_approx(x, steps, 10_000).alias(x) for x in STATISTICS]).collect()
    if len(cuts_of) < 2:
        return []
    cuts = {x: sorted({c for row in cuts_of for c in row[x] or []}) for x in STATISTICS}
    def passed(x: str, beyond) -> Column:
        """How many of the statistic's cuts its value has passed."""
        return F.aggregate(F.array(*map(F.lit, cuts[x])), F.lit(0), lambda n, cut: n + F.coalesce(beyond(F.col(x), cut), F.lit(False)).cast("int"))

    binned = F.explode(F.array(*[
        F.struct(F.lit(x).alias("statistic"), passed(x, lambda v, c: v >= c).alias("at"), passed(x, lambda v, c: v > c).alias("above"))
        for x in STATISTICS if cuts[x]
    ]))
    yes, no = F.sum(F.col("_y").cast("long")), F.sum((~F.col("_y")).cast("long"))

    def counts(rows: DataFrame) -> tuple[int, int]:
        got = rows.agg(F.coalesce(yes, F.lit(0)).alias("p"), F.coalesce(no, F.lit(0)).alias("n")).first()
        return got["p"], got["n"]

    rules: list[Rule] = []
    covered = F.lit(False)
    for _ in range(max_rules):
        open_rows = sample.where(~covered)
        conditions: list[Condition] = []
        grown = open_rows.where("_grow")
        p, n = counts(grown)
        while p and n and len(conditions) < max_conditions:
            rows = grown.select("_y", binned.alias("b")).groupBy("b.statistic", "b.at", "b.above").agg(yes.alias("p"), no.alias("n")).collect()
            best = _best_condition(rows, cuts, p, n)
            if best is None:
                break
            conditions.append(best[0])
            p, n = best[1:]
            grown = grown.where(best[0].column())
        if not conditions:
            break
        rule = _pruned(open_rows.where("not _grow"), conditions, counts)
        p, n = counts(open_rows.where(rule.column()))
        if rule.precision < min_precision or p < min_covered or p < min_precision * (p + n):
            break
        rules.append(rule)
        covered = covered | F.coalesce(rule.column(), F.lit(False))
    return rules


def _best_condition(rows, cuts, p: int, n: int) -> tuple[Condition, int, int] | None:
    """The condition of largest FOIL gain over `p` rejected and `n` kept rows, and what it leaves of each."""
    best, gain_of_best = None, 1e-9
    for x, its_cuts in cuts.items():
        own = [r for r in rows if r["statistic"] == x]
        for k, cut in enumerate(its_cuts):
            for at_least in (True, False):
                inside = [r for r in own if (r["at"] > k if at_least else r["above"] <= k)]
                a, b = sum(r["p"] for r in inside), sum(r["n"] for r in inside)
                if not a or a + b == p + n:
                    continue
                gain = a * (math.log2(a / (a + b)) - math.log2(p / (p + n)))
                if gain > gain_of_best:
                    best, gain_of_best = (Condition(x, at_least, cut), a, b), gain
    return best


def _pruned(rows: DataFrame, conditions: list[Condition], counts) -> Rule:
    """The prefix of `conditions` with the best (p - n) / (p + n) on the pruning rows; the shortest of equals."""
    best = None
    for k in range(1, len(conditions) + 1):
        rule = Rule(tuple(conditions[:k]), 0.0)
        p, n = counts(rows.where(rule.column()))
        worth = (p - n) / (p + n) if p + n else -1.0
        if best is None or worth > best[0]:
            best = (worth, Rule(rule.conditions, p / (p + n) if p + n else 0.0))
    return best[1]


def rejected_by(rules: list[Rule]) -> Column:
    """The first rule that fits, counted from 1, as one ordered conditional expression; else null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(rules[k - 1].column(), k).otherwise(out)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts of at most `max_rows` labelled documents, those of least hash of the id; a label per id.

    `label` is made of columns of `labels`. The bound holds at every input size.
    """
    chosen = (
        labels.select(id_col, label.alias("_label")).where(F.col("_label").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col).agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    )
    return docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)


def filter_by_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_sample: int = 20_000, **learning) -> DataFrame:
    """One row per document: id, the counts, base_failed, rule (the first that fits, or null), kept.

    Rules are learned from `labels` (quality 0: reject, 1: keep) on at most `max_sample` labelled
    documents, with the limits of learn_rules(): by default at most 8 rules of at most 3 conditions
    each, whose thresholds are 23 quantiles of either label (`max_rules`, `max_conditions`, `bins`).
    A null or empty text has no words and so fails the base rules. Without labels the
    base rules alone decide. Repeated rows come out repeatedly; other columns aren't looked at.
    """
    sample = labelled_sample(docs, labels, label=F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0), max_rows=max_sample, id_col=id_col, text_col=text_col)
    rules = learn_rules(with_statistics(sample, text_col).where(~base_failed()), label_col="_label", id_col=id_col, **learning)
    counted = with_statistics(docs.select(F.col(id_col), F.col(text_col)), text_col)
    return counted.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), rejected_by(rules).alias("rule"),
    ).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
