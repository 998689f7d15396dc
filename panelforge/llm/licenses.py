"""Licence scan by canonical digests.

A text is brought to a canonical form (case, spellings, copyright lines, punctuation, white
space), and the SHA-256 of the whole form is looked up in a table of known digests by an equi-join.
The same holds for each line of the text against known one-line notices. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import DIGESTS, NOTICES, TEXTS
from .tables import is_small, saved, text_of

# The public list of equivalent words in licence texts; the first form becomes the second.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"),
    ("behaviour", "behavior"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalis", "capitaliz"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("fulfill", "fulfil"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"),
    ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"),
    ("organis", "organiz"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("utilis", "utiliz"), ("whilst", "while"), ("willful", "wilful"),
    ("non-commercial", "noncommercial"), ("non-infringement", "noninfringement"), ("sub-license", "sublicense"),
    ("copyright owner", "copyright holder"), ("http://", "https://"), ("&", " and "),
]
#: A line that states who holds the copyright, or that rights are reserved.
COPYRIGHT_LINE = r"(?m)^[^\w\n]*(?:(?:portions )?(?:copyright|©|\(c\))(?:[ \t,:]|\(c\)|©)*(?:[0-9]{4}|[\[<{]|by )[^\n]*|all rights reserved[^\w\n]*)$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
SPACED_BREAK = r" *\n[ \n]*"


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks, no empty line and no space at a line's ends."""
    out = F.lower(text)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, PUNCTUATION, " ")
    return F.trim(F.regexp_replace(out, SPACED_BREAK, "\n"), F.lit(" \n"))


def canonical(text: Column) -> Column:
    """The canonical form as one line."""
    return F.replace(canonical_lines(text), F.lit("\n"), F.lit(" "))


def known_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """license_id, digest, length (in characters) of the texts' canonical forms."""
    form = canonical(F.col("body"))
    return spark.createDataFrame(texts, "license_id string, body string").select("license_id", F.sha2(form, 256).alias("digest"), F.length(form).alias("length"))


def scan_licenses(
    docs: DataFrame, known_texts: DataFrame, known_notices: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000
) -> DataFrame:
    """One row per document: id, digest of its canonical form, license_id (null unless the whole
    text is a known one), notice_ids (the sorted licences of its lines that are known notices).

    Known tables have license_id, digest and, if they like, length; of several licences with one
    whole text the first by name counts, of several with one notice all. Null and empty texts, and
    those of punctuation or copyright lines alone, have the digest of the empty form, which no
    licence has. Equal documents get equal rows, repeated rows stay repeated, an empty table gives
    none; other columns are not looked at. Texts are read once and never shuffled: their digests,
    and those of their lines that are as long as some notice, are written and joined. What is
    joined with them is broadcast if it has at most `broadcast_rows` rows, and shuffled else, with
    the same result.
    """
    def side(df: DataFrame) -> DataFrame:
        df = saved(df)  # a join of two exchanges is split by adaptive execution where a digest is hot
        return F.broadcast(df) if is_small(df, broadcast_rows) else df

    sized = known_notices if "length" in known_notices.columns else known_notices.withColumn("length", F.lit(None).cast("int"))
    low, high, all_sized = sized.agg(F.min("length"), F.max("length"), F.count("length") == F.count("*")).first()
    lines = F.array_distinct(F.split("_form", "\n"))
    if all_sized and low is not None:
        lines = F.filter(lines, lambda x: F.length(x).between(low, high))
    forms = saved(docs.select(F.col(id_col).alias("_id"), canonical_lines(text_of(text_col)).alias("_form")).select(
        "_id",
        F.unhex(F.sha2(F.replace("_form", F.lit("\n"), F.lit(" ")), 256)).alias("_whole"),
        F.unhex(F.sha2("_form", 256)).alias("_key"),
        F.transform(lines, lambda x: F.unhex(F.sha2(x, 256))).alias("_lines"),
    ))
    whole = known_texts.where("license_id is not null").groupBy(F.unhex("digest").alias("_whole")).agg(F.min("license_id").alias("license_id"))
    notice = known_notices.where("license_id is not null").groupBy(F.unhex("digest").alias("_line")).agg(F.collect_set("license_id").alias("_ids"))
    found = (
        forms.select("_key", F.explode("_lines").alias("_line")).distinct()
        .join(side(notice), "_line")
        .groupBy("_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias("notice_ids"))
    )
    return forms.join(side(whole), "_whole", "left").join(side(found), "_key", "left").select(
        F.col("_id").alias(id_col), F.lower(F.hex("_whole")).alias("text_digest"), "license_id",
        F.coalesce("notice_ids", F.array().cast("array<string>")).alias("notice_ids"),
    )


def default_known(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    digests = spark.createDataFrame([(name, digest, length) for name, _, _, length, digest in DIGESTS], "license_id string, digest string, length int")
    return known_digests(spark, TEXTS).unionByName(digests), known_digests(spark, NOTICES)
