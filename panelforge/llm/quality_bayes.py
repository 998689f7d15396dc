"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier of text statistics gives each document its evidence (a log likelihood ratio).
Grouped aggregation over hosts and over paths below them gives each site its share of good
documents, by the classifier's posteriors: a host's share is shrunk toward the global one, a path's
toward its host's, with Beta priors whose strength is estimated from how much sites differ. A
document's posterior combines its own evidence with its path's share, from which the document
itself is taken out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import labelled_sample, with_statistics
from .tables import fresh, is_small, saved

#: What the classifier sees: rates are taken to the root, which spreads small ones out.
INPUTS = ["symbol_rate", "upper_rate", "mark_rate", "digit_rate", "dup_line_rate", "distinct_rate", "long_word_rate", "mean_word", "n_words"]


def _input(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.log1p(value) if name in ("n_words", "mean_word") else F.sqrt(value)


@dataclass
class Classifier:
    """Logistic over standardised inputs and their squares. `base` is the sample's log odds."""

    means: list[float]
    scales: list[float]
    weights: list[float]
    base: float

    def evidence(self) -> Column:
        """Log likelihood ratio of good against bad, from the columns of with_statistics()."""
        out = F.lit(self.weights[0] - self.base)
        n = len(INPUTS)
        for k, name in enumerate(INPUTS):
            z = F.least(F.greatest((_input(name) - self.means[k]) / self.scales[k], F.lit(-6.0)), F.lit(6.0))
            out = out + self.weights[1 + k] * z + self.weights[1 + n + k] * z * z
        return F.least(F.greatest(out, F.lit(-30.0)), F.lit(30.0))


def fit(sample: DataFrame, *, label_col: str = "_label", ridge: float = 0.05) -> Classifier:
    """The classifier of a bounded sample that has with_statistics() and a label, 1 for good.

    A sample without one of the labels gives no evidence either way.
    """
    rows = sample.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("double"), *[_input(x) for x in INPUTS]).collect()
    data = np.array(rows, float).reshape(-1, 1 + len(INPUTS))
    y, x = data[:, 0], data[:, 1:]
    n = len(INPUTS)
    if not len(y) or y.min() == y.max():
        return Classifier([0.0] * n, [1.0] * n, [0.0] * (1 + 2 * n), 0.0)
    means, scales = x.mean(0), x.std(0) + 1e-3
    z = np.clip((x - means) / scales, -6, 6)
    z = np.hstack([np.ones((len(z), 1)), z, z * z])
    w = np.zeros(z.shape[1])
    penalty = ridge * np.diag([1e-4] + [1.0] * (2 * n))
    for _ in range(60):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return Classifier(means.tolist(), scales.tolist(), w.tolist(), base)


def _odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(mean: float, spread: float, groups: int, total: float) -> float:
    """Pseudo-documents of a Beta prior: from the spread of group means beyond what sampling makes."""
    noise = mean * (1 - mean)
    between = max(spread - noise * groups / max(total, 1.0), noise * 1e-4, 1e-9)
    return min(max(noise / between - 1, 2.0), 10_000.0)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, n, s, host_posterior, strength of all paths, from (host, path, p) rows.

    `n` documents with posteriors of sum `s`. Only sums per path and host move between tasks, and
    only a row of global moments comes to the driver.
    """
    paths = saved(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_s"), F.count("*")).first()
    n, s, groups = float(total[0] or 0), float(total[1] or 0.0), total[2]
    mean = (s + 0.5) / (n + 1)
    spread = hosts.agg(F.sum(F.col("host_n") * F.pow(F.col("host_s") / F.col("host_n") - mean, 2)) / max(n, 1.0)).first()[0] or 0.0
    strength = _strength(mean, spread, groups, n)
    hosts = hosts.withColumn("host_posterior", (strength * mean + F.col("host_s")) / (strength + F.col("host_n")))
    joined = paths.join(F.broadcast(hosts) if is_small(hosts, 100_000) else hosts, "host")
    got = joined.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_posterior"), 2)) / max(n, 1.0), F.count("*")).first()
    return joined.select("host", "path", "n", "s", "host_posterior", F.lit(_strength(mean, got[0] or 0.0, got[1], n)).alias("strength"))


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    max_sample: int = 20_000,
    broadcast_sites: int = 100_000,
) -> DataFrame:
    """`docs` with evidence, host_posterior, path_posterior, quality_score (of being good) and kept (0.5 or more).

    The host is `host_col` up to its first `/`; the path is all of `host_col` with `path_col`. Nulls
    there count as empty names. The classifier is fit on at most `max_sample` labelled documents
    (quality 1: good); without labels it gives no evidence, and all scores are 0.5. A null text
    counts as empty; it is scored like any text. A site of one document gets its host's posterior,
    a host of one document nearly the global one. Texts are read twice and never shuffled, unless
    there are more than `broadcast_sites` sites. Repeated rows stay repeated, an empty table gives
    none; columns named like the new ones are replaced.
    """
    sample = labelled_sample(docs, labels, label=F.when(F.col("quality").isin(0, 1), F.col("quality")), max_rows=max_sample, id_col=id_col, text_col=text_col)
    model = fit(with_statistics(sample, text_col, repeats=False))
    docs = docs.drop("evidence", "host_posterior", "path_posterior", "quality_score", "kept")
    site = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    host, path = F.split_part(site, F.lit("/"), F.lit(1)), F.concat_ws("\x00", site, F.coalesce(F.col(path_col).cast("string"), F.lit("")))
    mine = docs.select(F.col(text_col).alias("text"), host.alias("host"), path.alias("path"))
    scored = with_statistics(mine, repeats=False).select("host", "path", (1 / (1 + F.exp(-(model.evidence() + model.base)))).alias("p"))
    sites = saved(site_posteriors(scored).drop("host"))  # so that adaptive execution can split a hot path where they aren't broadcast
    sites = F.broadcast(sites) if is_small(sites, broadcast_sites) else sites
    row, key = fresh("row", docs), fresh("path", docs)
    packed = docs.select(F.struct(*docs.columns).alias(row), F.col(text_col).alias("_text"), path.alias(key))
    out = with_statistics(packed, "_text", repeats=False).select(row, key, model.evidence().alias("_e"))
    out = out.join(sites.withColumnRenamed("path", key), key)
    own = 1 / (1 + F.exp(-(F.col("_e") + model.base)))
    posterior = (F.col("strength") * F.col("host_posterior") + F.greatest(F.col("s") - own, F.lit(0.0))) / (F.col("strength") + F.col("n") - 1)
    combined = 1 / (1 + F.exp(-(F.col("_e") + _odds(F.col("_path")))))
    return (
        out.withColumn("_path", posterior).withColumn("_score", combined)
        .select(f"{row}.*", F.col("_e").alias("evidence"), "host_posterior", F.col("_path").alias("path_posterior"), F.col("_score").alias("quality_score"), (F.col("_score") >= 0.5).alias("kept"))
    )
