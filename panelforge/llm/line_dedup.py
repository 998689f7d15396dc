"""Line deduplication by pairwise alignment.

What two documents can share are blocks of lines with enough words. Each line with enough words by
itself, and each least run of lines that has them together, is a key; every document that holds a
key meets the earliest document that holds it, so pairs are linear in lines, however frequent a
line is. Rare keys find the documents that overlap; a hot one adds no more than one pair a document.
Each pair is aligned by patience diff over its runs, and the aligned blocks, and nothing else, are
deleted from the later document; blocks that cross an alignment, since they were moved or are
repeated, are found by aligning what is left anew. The earliest holder of a line never loses it, so no
line is lost altogether, and aligning with all earlier documents would delete nothing more.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bind, fresh, saved, text_of

#: A letter, digit or underscore of any script; a line without one is not compared.
WORD = r"[\p{L}\p{N}_]"
#: Letters of scripts that write no spaces between words: Chinese and Japanese, of which two make a word,
#: and Thai, Lao, Tibetan, Burmese, Khmer and their like, of which four do.
_BY_TWO = r"\u3005-\u3007\u3040-\u312F\u31A0-\u31BF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uA000-\uA4CF\uF900-\uFAFF\uFF66-\uFF9F\x{1B000}-\x{1B16F}\x{20000}-\x{3FFFF}"
_BY_FOUR = r"\u0E00-\u109F\u1780-\u17FF\u1950-\u19DF\u1A20-\u1AAF\uA9E0-\uA9FF\uAA60-\uAADF"
_SIGNS = rf"[^\s\p{{L}}\p{{N}}{_BY_TWO}{_BY_FOUR}]*"
_WORDS = rf"[{_BY_TWO}]{{1,2}}{_SIGNS}|[{_BY_FOUR}]{{1,4}}{_SIGNS}|[^\s{_BY_TWO}{_BY_FOUR}]+"


def _line_key(line: Column) -> Column:
    """A line without the white space at its ends."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def word_count(line: Column) -> Column:
    """Words between white space; in scripts without spaces, by the number of letters."""
    unspaced = F.rlike(line, F.lit(f"[{_BY_TWO}{_BY_FOUR}]"))
    return F.when(unspaced, F.regexp_count(line, F.lit(_WORDS))).otherwise(F.regexp_count(line, F.lit(r"\S+")))


#: Alignments of a pair, one after the other, each of what the ones before have left. A pair that takes
#: more, as a list and the same list reversed, is left to alignments of one run each.
ROUNDS = 64


def _patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (in a, in b) of equal symbols, rising in both: symbols that occur once on either side of a gap,
    the longest rising chain of them, and so on between them; equal ends of a gap at once.

    Where no symbol is so, as among repeats, the first places of each are taken, and that gap is left.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {x for x, n in in_a.items() if n == 1 and in_b[x] == 1}
        first_a = {a[i]: i for i in range(a1 - 1, a0 - 1, -1)}
        first_b = {b[j]: j for j in range(b1 - 1, b0 - 1, -1)}
        anchors = sorted((i, first_b[x]) for x, i in first_a.items() if (x in once if once else x in first_b))
        # the longest chain of anchors that rises in both
        tops: list[int] = []
        chain: list[int] = []
        before = [-1] * len(anchors)
        for k, (_, j) in enumerate(anchors):
            at = bisect_left(tops, j)
            before[k] = chain[at - 1] if at else -1
            tops[at : at + 1] = [j]
            chain[at : at + 1] = [k]
        k, rising = chain[-1] if chain else -1, []
        while k >= 0:
            rising.append(anchors[k])
            k = before[k]
        out += rising
        if once:
            i0, j0 = a0, b0
            for i, j in [*reversed(rising), (a1, b1)]:
                todo.append((i0, i, j0, j))
                i0, j0 = i + 1, j + 1
    return out


def _aligned(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places (in a, in b) of the symbols that alignments of a with b have in common; 0 is none.

    Blocks that were moved or repeated cross an alignment, so what it leaves of a is aligned with
    the whole of b again, until an alignment finds nothing more.
    """
    at_a, at_b = np.flatnonzero((a != 0) & np.isin(a, b)).tolist(), np.flatnonzero((b != 0) & np.isin(b, a)).tolist()
    mine, others = a[at_a].tolist(), b[at_b].tolist()
    out: list[tuple[int, int]] = []
    for k in range(ROUNDS + 1):
        if k < ROUNDS:
            found = _patience(mine, others)
        else:
            first = {x: j for j, x in reversed(list(enumerate(others)))}
            found = [(i, first[x]) for i, x in enumerate(mine)]
        out += [(at_a[i], at_b[j]) for i, j in found]
        gone = {i for i, _ in found}
        at_a, mine = [x for i, x in enumerate(at_a) if i not in gone], [x for i, x in enumerate(mine) if i not in gone]
        if not found or not at_a:
            break
        left = set(mine)
        at_b, others = [j for j, x in zip(at_b, others, strict=True) if x in left], [x for x in others if x in left]
    return out


def aligned_blocks(mine: Lines, others: Lines) -> list[tuple[int, int, int]]:
    """Blocks (start in mine, start in others, lines) that two documents share, joined where they go on, in order."""
    runs = {(i, j, int(mine.ahead_size[i])) for i, j in _aligned(mine.ahead, others.ahead)}
    runs |= {(i - n + 1, j - n + 1, n) for i, j in _aligned(mine.back, others.back) for n in [int(mine.back_size[i])]}
    joined: list[tuple[int, int, int]] = []
    for shift, i, n in sorted((i - j, i, n) for i, j, n in runs):
        if joined and joined[-1][0] - joined[-1][1] == shift and joined[-1][0] + joined[-1][2] >= i:
            i0, j0, n0 = joined[-1]
            joined[-1] = (i0, j0, max(n0, i + n - i0))
        else:
            joined.append((i, i - shift, n))
    return sorted(joined)


def line_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (id, and a hash of the text), hashes (64 bits for each line, 0 for one without a word), words (of each line).

    A row for each text of an id: rows that share both are one document.
    """
    lines = F.split(text_of(text_col), "\n")
    return (
        docs.where(F.col(id_col).isNotNull())
        .select(
            F.struct(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("h")).alias("doc"),
            F.transform(lines, lambda x: F.when(F.rlike(x, F.lit(WORD)), F.xxhash64(_line_key(x))).otherwise(F.lit(0))).alias("hashes"),
            F.transform(lines, word_count).alias("words"),
        )
        .groupBy("doc").agg(F.first("hashes").alias("hashes"), F.first("words").alias("words"))
    )


def _runs(hashes: np.ndarray, words: np.ndarray, rows: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the key and the number of lines of the least run from it on that has `min_words` words; 0 where there is none.

    `rows` is the document of each line. A run is of lines of one document that count, each of which has a word.
    """
    out, size = np.where((words >= min_words), hashes, 0), (words >= min_words).astype(np.int32)
    at = np.flatnonzero((hashes != 0) & (words < min_words))
    key, sums = hashes[at].view(np.uint64), words[at].astype(np.int64)
    for k in range(1, min_words):
        on = at + k < len(hashes)
        at, key, sums = at[on], key[on], sums[on]
        on = (rows[at] == rows[at + k]) & (hashes[at + k] != 0)
        at, key, sums = at[on], key[on], sums[on]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k].view(np.uint64)
        sums = sums + words[at + k]
        done = sums >= min_words
        out[at[done]], size[at[done]] = key[done].view(np.int64), k + 1
        at, key, sums = at[~done], key[~done], sums[~done]
    return out, size


@dataclass
class Lines:
    """Lines as symbols: for each, the run from it on and the run back from it.

    Each line of a block of `min_words` words is in a run of one of the two kinds within the block.
    """

    ahead: np.ndarray
    ahead_size: np.ndarray
    back: np.ndarray
    back_size: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray, words: np.ndarray, min_words: int, rows: np.ndarray | None = None) -> Lines:
        rows = np.zeros(len(hashes), np.int64) if rows is None else rows
        back, size = (x[::-1] for x in _runs(hashes[::-1].copy(), words[::-1].copy(), rows[::-1].copy(), min_words))
        # ~: what is read backwards must not be taken for the same lines in the other order, read forwards
        return cls(*_runs(hashes, words, rows, min_words), np.where(size > 1, ~back, 0), np.where(size > 1, size, 0))

    def part(self, a: int, b: int) -> Lines:
        return Lines(self.ahead[a:b], self.ahead_size[a:b], self.back[a:b], self.back_size[a:b])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, one after the other, and where each list starts."""
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], ends]).astype(np.int64)


def run_keys(index: DataFrame, *, min_words: int = 5) -> DataFrame:
    """doc, line: the keys of runs of two lines or more, of documents that have short lines."""
    kind = index.schema["doc"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, starts = _flat(batch.column("hashes"))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            own = Lines.of(hashes, batch.column("words").flatten().to_numpy(zero_copy_only=False), min_words, rows)
            ahead, back = own.ahead_size > 1, own.back_size > 1
            found = np.unique(np.stack([np.concatenate([rows[ahead], rows[back]]), np.concatenate([own.ahead[ahead], own.back[back]])]), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(found[0])), pa.array(found[1])], ["doc", "line"])

    short = F.exists(F.arrays_zip("hashes", "words"), lambda x: (x["hashes"] != 0) & (x["words"] < min_words))
    return index.where(short).select("doc", "hashes", "words").mapInArrow(keys, f"doc {kind}, line long")


def overlapping_pairs(index: DataFrame, *, min_words: int = 5) -> DataFrame:
    """doc, earlier: each document with the earliest holder of each of its shared lines and runs of lines."""
    long = F.transform(F.filter(F.arrays_zip("hashes", "words"), lambda x: (x["hashes"] != 0) & (x["words"] >= min_words)), lambda x: x["hashes"])
    held = index.select("doc", F.explode(F.array_distinct(long)).alias("line")).unionByName(run_keys(index, min_words=min_words))
    # written, so that the join below is of two exchanges, of which adaptive execution splits large partitions
    shared = saved(held.groupBy("line").agg(F.min("doc").alias("earlier"), F.count("*").alias("holders")).where("holders > 1").drop("holders"))
    return held.join(shared, "line").where(F.col("doc") > F.col("earlier")).select("doc", "earlier").distinct()


def duplicated_blocks(index: DataFrame, pairs: DataFrame, *, min_words: int = 5) -> DataFrame:
    """doc, earlier, start, other, n: `n` lines of `doc` from line `start` (from 0) on are those of `earlier` from `other` on."""
    kind = index.schema["doc"].dataType.simpleString()
    both = (
        pairs.join(index.select("doc", "hashes", "words"), "doc")
        .join(index.select(F.col("doc").alias("earlier"), F.col("hashes").alias("their_hashes"), F.col("words").alias("their_words")), "earlier")
        .select("doc", "earlier", "hashes", "words", "their_hashes", "their_words")
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for h, w in (("hashes", "words"), ("their_hashes", "their_words")):
                hashes, starts = _flat(batch.column(h))
                rows = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                sides.append((Lines.of(hashes, batch.column(w).flatten().to_numpy(zero_copy_only=False), min_words, rows), starts.tolist()))
            (mine, a), (others, b) = sides
            found = [(k, *x) for k in range(batch.num_rows) for x in aligned_blocks(mine.part(a[k], a[k + 1]), others.part(b[k], b[k + 1]))]
            of, *numbers = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [], [])
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(of), batch.column("earlier").take(of), *[pa.array(x, pa.int32()) for x in numbers]], ["doc", "earlier", "start", "other", "n"]
            )

    return both.mapInArrow(align, f"doc {kind}, earlier {kind}, start int, other int, n int")


def duplicated_lines(blocks: DataFrame) -> DataFrame:
    """doc, lines: the sorted line numbers (from 0) of its blocks."""
    at = F.sequence("start", F.col("start") + F.col("n") - 1)
    return blocks.select("doc", F.explode(at).alias("at")).groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("lines"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """`docs` with the text after deletion, plus n_lines and n_deleted.

    Of two documents the one of larger id is the later; of two texts of one id, the one whose hash
    is larger. Every block that an earlier document holds goes, wherever it stands and as often as
    it is repeated; repeats of a document's own lines stay. Lines are compared without the white space
    at their ends; lines without a word are never deleted, nor are blocks of fewer than `min_words`
    words, which recur by chance (see word_count() for scripts without spaces). A null text stays
    null and has no lines; a document all of whose lines go is left with an empty text. Rows of one
    id and one text are one document and lose the same lines; rows without an id meet none and stay
    as they are. An empty table gives none; other columns stay, whatever their names but for n_lines
    and n_deleted, which are replaced.
    """
    index = saved(line_index(docs, id_col=id_col, text_col=text_col))
    docs = docs.drop("n_lines", "n_deleted")
    key, gone = fresh("key", docs), fresh("gone", docs)
    blocks = duplicated_blocks(index, overlapping_pairs(index, min_words=min_words), min_words=min_words)
    found = duplicated_lines(blocks).select(F.col("doc").alias(key), F.col("lines").alias(gone))
    own = F.struct(docs[id_col].alias("id"), F.xxhash64(text_of(text_col)).alias("h"))
    text, lines = F.col(text_col), F.split(F.col(text_col), "\n")
    # deleted line numbers are sorted: what stays are the lines between them, cut out as slices
    between = F.concat(F.array(F.lit(-1)), F.col(gone), F.array(F.size(lines)))
    kept = bind(
        F.struct(lines.alias("lines"), between.alias("at")),
        lambda x: F.flatten(F.transform(
            F.sequence(F.lit(1), F.size(x["at"]) - 1),
            lambda k: F.slice(x["lines"], F.get(x["at"], k - 1) + 2, F.get(x["at"], k) - F.get(x["at"], k - 1) - 1),
        )),
    )
    left = F.when(F.col(gone).isNull() | text.isNull(), text).otherwise(F.array_join(kept, "\n"))
    return docs.join(found, own == found[key], "left").select(
        *[left.alias(c) if c == text_col else docs[c] for c in docs.columns],
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_deleted"),
    )
