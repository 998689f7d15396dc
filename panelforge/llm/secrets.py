"""Secret scans by sliding-window entropy.

Three patterns find secrets by their form. For the others, every run of the characters that encoded
keys are written in is a candidate: a window slides over it, and the Shannon entropy of the window's
characters follows from counts of which each step changes two. Windows above the class's threshold
are a find, joined where they meet, unless the run is on the allow-list, or doesn't mix letters and digits as
keys do. All of it is built-in
expressions within a row: nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bind, text_of

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_KEYWORD = "password|passwd|secret|token|api_?key"
#: Letters in either case, spelled out, so that no engine folds letters beyond ASCII.
_EITHER = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in _KEYWORD)
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"(?:{_EITHER})[\"']?\x20*[:=]\x20*[\"']?({VALUE})"
LEAST_VALUE = 8
#: A run that is too short fails as a whole, so its least length can be part of the pattern.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"


@dataclass(frozen=True)
class CharacterClass:
    """Runs of `window` or more characters of `alphabet`, of which windows with more bits a character than `bits` are finds."""

    kind: str
    characters: str  # as within the brackets of a pattern
    alphabet: str
    window: int
    bits: float

    @property
    def pattern(self) -> str:
        return f"[{self.characters}]{{{self.window},}}"


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("entropy_hex", "0-9A-Fa-f", _DIGITS + "abcdefABCDEF", 20, 3.0),
    CharacterClass("entropy_base64", "A-Za-z0-9+/_=-", _UPPER + _LOWER + _DIGITS + "+/_=-", 24, 3.8),
)
#: A key mixes letters and digits; words, slugs, paths and numbers hardly do.
MIXED = "[A-Za-z][0-9]|[0-9][A-Za-z]"
#: The allow-list: a run in which one of these is found is no secret.
ALLOWED = (
    "^[A-Za-z]+[0-9]{1,4}$",  # a name with a number
    "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",  # a UUID
    "^0[xX][0-9A-Fa-f]+$",  # an address or a number
    "EXAMPLE|[Ee]xample|XXXX|xxxx|0000|0123456789|123456789|abcdef|ABCDEF",  # placeholders
)
BASE_KINDS = ("assign", "access", "hex")


def _places(text: Column, pattern: str, where: Column) -> Column:
    """start, end, found: the leftmost non-overlapping matches, in code points from 0, ends excluded; none unless `where`.

    Where they stand follows from the lengths of what is between them.
    """
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def placed(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("done"))

        def on(s: Column, p: Column) -> Column:
            begin = s["at"] + F.length(p["piece"])
            end = begin + F.length(p["found"])
            return F.struct(end.alias("at"), F.concat(s["done"], F.array(F.struct(begin.alias("start"), end.alias("end"), p["found"].alias("found")))).alias("done"))

        pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        both = F.arrays_zip(pieces.alias("piece"), found.alias("found"))
        named = F.transform(both, lambda p: F.struct(p["piece"].alias("piece"), p["found"].alias("found")))
        return F.when(F.size(found) == 0, none).otherwise(F.aggregate(named, start, on, lambda s: s["done"]))

    return F.when(where, bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _spans(places: Column, kind: str, number: int) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(number).alias("number"), p["end"].alias("end"), F.lit(kind).alias("kind")))


def has_keyword(text: Column) -> Column:
    """Whether ASSIGN can match at all: a plain search, far cheaper than the pattern."""
    return bind(F.lower(text), lambda x: reduce(or_, [F.contains(x, F.lit(k)) for k in KEYWORDS]))


def has_run(text: Column, least: int) -> Column:
    """Whether some run is long enough for HEX or for a class."""
    return F.rlike(text, F.lit(f"[A-Za-z0-9+/_=-]{{{least},}}"))


def base_spans(text: Column, keyword: Column, run: Column) -> Column:
    """start, number, end, kind of what the three patterns find; `keyword` and `run` say whether ASSIGN and HEX are worth a search."""
    assign = F.filter(_places(text, ASSIGN, keyword), lambda p: F.length(F.regexp_extract(p["found"], ASSIGN, 1)) >= LEAST_VALUE)
    places = (assign, _places(text, ACCESS, F.contains(text, F.lit("AKIA"))), _places(text, HEX, run))
    return F.concat(*[_spans(x, kind, k) for k, (kind, x) in enumerate(zip(BASE_KINDS, places, strict=True))])


def windows_above(run: Column, of: CharacterClass) -> Column:
    """start, end within `run` of the joined windows of `of.window` characters that have more than `of.bits` bits a character.

    The counts of the window's characters change by the one that enters and the one that leaves, and
    with them the sum of n log n, from which the entropy follows.
    """
    w, n_log_n = of.window, F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(of.window + 2)])
    most = w * math.log2(w) - w * of.bits  # the sum of n log n at the threshold
    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(
        F.array_repeat(F.lit(0), len(of.alphabet)).alias("counts"), F.lit(0.0).alias("sum"), none.alias("done"), F.lit(-1).alias("start"), F.lit(-1).alias("end")
    )

    def slide(codes: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.when(i >= w, F.get(codes, i - w)).otherwise(F.lit(-1))
            more = F.get(s["counts"], enters)
            less = F.when(i >= w, F.get(s["counts"], leaves) + (enters == leaves).cast("int"))
            total = s["sum"] + F.get(n_log_n, more + 1) - F.get(n_log_n, more) + F.when(i >= w, F.get(n_log_n, less - 1) - F.get(n_log_n, less)).otherwise(0.0)
            counts = F.transform(s["counts"], lambda c, k: c + (k == enters).cast("int") - (k == leaves).cast("int"))
            moved = F.struct(counts.alias("counts"), total.alias("sum"))

            def find(m: Column) -> Column:
                hit = (i >= w - 1) & (m["sum"] < most)
                joins = hit & (s["start"] >= 0) & (i - w + 1 <= s["end"])
                fresh = hit & ~joins
                return F.struct(
                    m["counts"].alias("counts"),
                    m["sum"].alias("sum"),
                    F.when(fresh & (s["start"] >= 0), F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["done"]).alias("done"),
                    F.when(fresh, i - w + 1).otherwise(s["start"]).alias("start"),
                    F.when(hit, i + 1).otherwise(s["end"]).alias("end"),
                )

            return bind(moved, find)

        ends = lambda s: F.when(s["start"] >= 0, F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["done"])
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, step, ends)

    codes = F.transform(F.split(run, ""), lambda c: (F.position(c, F.lit(of.alphabet)) - 1).cast("int"))
    return F.when(F.length(run) >= w, bind(codes, slide)).otherwise(none)


def entropy_spans(text: Column, run: Column, of: CharacterClass, number: int, allowed: Sequence[str] = ALLOWED) -> Column:
    """start, number, end, kind of what one class finds."""
    runs = F.filter(_places(text, of.pattern, run), lambda p: F.rlike(p["found"], F.lit(MIXED)))
    if allowed:
        runs = F.filter(runs, lambda p: ~F.rlike(p["found"], F.lit("|".join(allowed))))
    found = F.flatten(F.transform(runs, lambda p: F.transform(windows_above(p["found"], of), lambda s: F.struct((p["start"] + s["start"]).alias("start"), (p["start"] + s["end"]).alias("end")))))
    return _spans(found, of.kind, number)


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[str] = ALLOWED) -> DataFrame:
    """One row per document: id, and secrets, an array of kind, start, end and base, in order of start, then kind.

    Places are code points from 0, ends excluded. A span that a class finds goes where one of an
    earlier kind holds it; those of the patterns (base) always stay. A null text counts as empty and has none;
    long texts are scanned whole; repeated rows stay repeated, rows without an id stay too, an empty
    table gives none. Other columns aren't looked at, whatever their names.
    """
    rows = docs.select(docs[id_col].alias("_id"), text_of(text_col).alias("_text"))
    rows = rows.withColumn("_keyword", has_keyword(F.col("_text"))).withColumn("_run", has_run(F.col("_text"), min([32, *[c.window for c in classes]])))
    parts = [entropy_spans(F.col("_text"), F.col("_run"), of, k, allowed) for k, of in enumerate(classes, len(BASE_KINDS))]
    spans = F.concat(base_spans(F.col("_text"), F.col("_keyword"), F.col("_run")), *parts)

    def held(all_: Column, s: Column) -> Column:
        """Whether a span of an earlier kind holds it."""
        return (s["number"] >= len(BASE_KINDS)) & F.exists(all_, lambda o: (o["number"] < s["number"]) & (o["start"] <= s["start"]) & (o["end"] >= s["end"]))

    own = bind(F.array_sort(spans), lambda all_: F.filter(all_, lambda s: ~held(all_, s)))
    in_order = F.transform(own, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["number"] < len(BASE_KINDS)).alias("base")))
    return rows.select(F.col("_id").alias(id_col), in_order.alias("secrets"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
