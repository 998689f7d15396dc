"""URL allow and block rules by hashed host-suffix and path-prefix expressions.

Each distinct URL is expanded into the expressions `host suffix + path prefix` that a rule could
have: suffixes of as many labels, and prefixes of as many characters, as some rule has, which
loses none and bounds the expansion by the rules and not by the URL. Expressions meet rules in an
equi-join on the first bytes of their SHA-256; the full digest then confirms the match, and the
longest rule wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import is_small

RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every `suffix + prefix` of the URL that has a rule's number of labels and characters."""
    # as filtered lists of numbers: the plan is as small for hundreds of lengths as for one
    n_labels, n_path = F.size(F.split(host, r"\.")), F.length(path)
    own = lambda numbers, most: F.filter(F.array(*map(F.lit, numbers)), lambda n: n <= most)
    parts = F.reverse(F.split(host, r"\."))
    suffixes = F.transform(own(labels, n_labels), lambda n: F.array_join(F.reverse(F.slice(parts, F.lit(1), n)), "."))
    prefixes = F.transform(own(lengths, n_path), lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    short_hex: int = 8,
    broadcast_rules: int = 50_000,
) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's path; of several
    the one with the most characters wins, and among those the one with the longer host. Where no
    rule fits, `default` is the verdict. A null or `://`-less URL has an empty host and path, which
    only a rule of empty host and path would fit. Rules whose host or path is null count as empty
    there; of equal rules, block goes before allow. Repeated pages come out repeatedly; an empty
    table gives an empty result; further columns of `pages` are not looked at. The rules are
    broadcast only if they number at most `broadcast_rules`.
    """
    rules = (
        rules.select(
            F.coalesce("host", F.lit("")).alias("rule_host"),
            F.coalesce("path", F.lit("")).alias("rule_path"),
            F.col("verdict").alias("rule_verdict"),
        )
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("rule_digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("rule_digest", 1, short_hex))
    )
    shape = rules.agg(
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()
    pages = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = url_host(F.col("_url")), url_path(F.col("_url"))
    if not shape["labels"]:
        return pages.select(F.col("_id").alias(id_col), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    if is_small(rules, broadcast_rules):
        rules = F.broadcast(rules)
    hits = (
        pages.select("_url").distinct().where(F.col("_url").isNotNull())
        .withColumn("_host", host).withColumn("_path", path)
        .withColumn("expression", F.explode(_expressions(F.col("_host"), F.col("_path"), sorted(shape["labels"]), sorted(shape["lengths"]))))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("short", F.substring("digest", 1, short_hex))
        .join(rules, "short")
        .where((F.col("digest") == F.col("rule_digest")) & ((F.col("_host") == F.col("rule_host")) | F.endswith("_host", F.concat(F.lit("."), "rule_host"))) & F.startswith("_path", F.col("rule_path")))
    )
    best = hits.groupBy("_url").agg(
        F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), F.length("rule_host"))).alias("best")
    )
    return pages.join(best, "_url", "left").select(
        F.col("_id").alias(id_col),
        host.alias("host"),
        path.alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )
