"""Near-duplicate join on word n-grams: Jaccard similarity of 0.8 or more, with Bayesian pruning.

1. Each text becomes a set of hashed five-word shingles and a MinHash signature. Texts of one set
   are a class, which is worked on once.
2. Classes that agree in one band of four MinHash values meet in a bucket. A bucket is compared
   block by block: pairs are compared by more and more MinHash values, and a pair goes as soon as
   the posterior probability (uniform prior) that its similarity reaches the threshold is below the
   tolerance. Of the pairs that stay, only a spanning forest of the block leaves the task; what the
   block's least class is linked with needs no other link, so close copies cost one comparison each.
3. The forests' connected components are the candidate groups. Each is compared block by block
   again, this time with the shingles: pruned in the same way, and verified exactly. What leaves a
   task is each class's number of links in the block, and a forest of them.

A block has a bounded number of classes and of shingles, so a bucket or group of any size is many
small tasks, no pair is ever a row, and no link between different texts is given up for a cap. A
group of n classes is n rows for each part of it: what is shuffled is the pairs that have to be
counted, divided by the size of a part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import fresh, is_small, saved, text_of

WORDS = 5
THRESHOLD = 0.8
HASHES = 128
ROWS = 4  # MinHash values of a band: at a similarity of 0.8 a pair misses all 32 bands once in 2e7
TOLERANCE = 1e-6
BUCKET_PART = 256, 64, 4_096  # classes of a part of a bucket, of which signatures alone are sent: these at least, then a 64th of the bucket, up to the last
GROUP_PART = 160, 10, 1_024  # the same of a group, of which shingles are sent too: ten parts up to 10,240 classes
PART_SHINGLES = 1 << 20  # shingles of a part of a group
STEPS = (8, 16, 24, 32, 48, 64, 96, 128)  # MinHash values after which a pair may go
_WORD = re.compile(r"\w+")


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles of lower-cased words.

    A text of fewer words has one shingle of all its words; a text without words has none.
    """
    found = _WORD.findall(text.lower())
    if not found:
        return np.zeros(0, np.uint64)
    memo: dict[str, int] = {}
    own = np.fromiter((memo[w] if w in memo else memo.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in found), np.uint64, len(found))
    n = max(1, len(found) - words + 1)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(min(words, len(found))):
        out ^= own[k : k + n]
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return np.unique(out)


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def signature(own: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits each."""
    a, b = _factors()
    low = (own ^ own >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 512):  # in slices that fit in the processor's cache
        mixed = low[None, i : i + 512] * a[:, None] + b[:, None]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(out, mixed.min(1), out=out)
    out ^= out >> np.uint32(16)
    return (out * np.uint32(0x297A2D39) >> np.uint32(16)).astype(np.uint16)


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each of STEPS, the fewest equal values with which a pair stays.

    With a uniform prior and m of n values equal the similarity is Beta(m + 1, n - m + 1), and it
    reaches t with the probability that a binomial of n + 1 draws at t gives m at most.
    """
    out = []
    for n in STEPS:
        below, m = 0.0, -1
        while below < tolerance:
            m += 1
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving(left: np.ndarray, right: np.ndarray, same: bool, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of two signature matrices that pruning leaves; for `same`, each pair once."""
    count = np.zeros((len(left), len(right)), np.int16)
    done = 0
    i = j = None
    for n, least in zip(STEPS, least_matches(threshold, tolerance), strict=True):
        if i is None:
            for k in range(done, n):
                count += left[:, k, None] == right[None, :, k]
            alive = count >= least
            if same:
                alive &= np.tri(len(left), k=-1, dtype=bool)
            if n == STEPS[-1] or alive.mean() < 0.2:  # few enough to go on pair by pair
                i, j = np.nonzero(alive)
                matched = count[i, j]
        else:
            if len(i):
                matched = matched + (left[i, done:n] == right[j, done:n]).sum(1, dtype=np.int16)
                stay = matched >= least
                i, j, matched = i[stay], j[stay], matched[stay]
        done = n
    return i, j


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact sizes of the intersections of sets[i] and sets[j]."""
    pairs = lambda: np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    if len(i) <= 24:
        return pairs()
    # sets as 0/1 rows over their shingles: products count the common ones; what one set alone has adds nothing, what all have adds 1
    tokens, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    some = (held > 1) & (held < len(sets))
    x, y = np.unique(i), np.unique(j)
    if 2.0 * len(x) * len(y) * some.sum() > 1e6 * len(i):  # few pairs of many shingles
        return pairs()
    stay = some[column]
    row, column = row[stay], (np.cumsum(some) - 1)[column[stay]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.full((len(x), len(y)), (held == len(sets)).sum(), np.float32)
    width = 8192
    for a in range(0, int(some.sum()), width):
        b, c = np.searchsorted(column, (a, a + width))
        bits = np.zeros((len(sets), width), np.float32)
        bits[row[b:c], column[b:c] - a] = 1
        total += bits[x] @ bits[y].T
    return total[np.searchsorted(x, i), np.searchsorted(y, j)].astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A star for each connected component of the pairs: (node, root) with the least node as the root."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in root if find(x) != x]


def sketches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, h (hash of the text), rep (64-bit digest of the shingle set), n_shingles, sig (binary) of each row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, sigs = [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py())
                digests.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "big", signed=True))
                sizes.append(len(own))
                sigs.append(signature(own).tobytes() if len(own) else b"")
            arrays = [batch.column("doc"), batch.column("h"), pa.array(digests, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "h", "rep", "n_shingles", "sig"])

    text = text_of(text_col)
    return docs.select(docs[id_col].alias("doc"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, f"doc {kind}, h long, rep long, n_shingles int, sig binary")


def _part_size(n: Column, bounds: tuple[int, int, int]) -> Column:
    """Members of a part of `n`: small parts where there are few, so that many tasks share them, larger ones where parts would be many."""
    least, parts, most = bounds
    return F.least(F.greatest(n / parts, F.lit(least)), F.lit(most))


def _blocks(members: DataFrame, key: str, parts: Column) -> DataFrame:
    """Members dealt out to blocks: `blk` is one pair of parts of one key, `side` the part of the member.

    A key has `parts` parts by a hash of the member, and each member goes to the blocks that pair
    its part with every part. `slot` numbers a key's blocks one after the other, from a place by the
    key on, so that the blocks of a large one go to as many partitions as there are.
    """
    parts = F.ceil(parts).cast("int")
    part = F.pmod(F.xxhash64("rep", F.lit(11)), parts).cast("int")
    return (
        members.withColumn("_parts", parts).withColumn("side", part)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("lo", F.least("side", "_other")).withColumn("hi", F.greatest("side", "_other"))
        .withColumn("blk", F.xxhash64(key, "lo", "hi"))
        .withColumn("slot", F.pmod(F.xxhash64(key) % (1 << 30) + F.col("hi").cast("long") * (F.col("hi") + 1) / 2 + F.col("lo"), F.lit(1 << 30)).cast("int"))
        .drop("_parts", "_other")
    )


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of whole blocks of rows sorted by `blk`; a block is never parted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        blk = batch.column("blk").to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(blk != blk[-1])[-1]) + 1 if blk[0] != blk[-1] else 0
        if held and (cut or held[-1].column("blk")[-1].as_py() != blk[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _groups(table: pa.Table) -> Iterator[tuple[int, int]]:
    blk = table.column("blk").to_numpy()
    edges = np.flatnonzero(np.diff(blk)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(blk)], strict=True)


def _sides(lo: np.ndarray, hi: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of a block's two parts, and whether both are the same part."""
    if lo[0] == hi[0]:
        own = np.arange(len(side))
        return own, own, True
    return np.flatnonzero(side == lo[0]), np.flatnonzero(side == hi[0]), False


def _star(sigs: np.ndarray, hub: int) -> np.ndarray:
    """Which rows pruning leaves as pairs of the row `hub`."""
    on = np.ones(len(sigs), bool)
    matched = np.zeros(len(sigs), np.int16)
    done = 0
    for n, least in zip(STEPS, least_matches(THRESHOLD, TOLERANCE), strict=True):
        at = np.flatnonzero(on)
        matched[at] += (sigs[at, done:n] == sigs[hub, done:n]).sum(1, dtype=np.int16)
        on[at] = matched[at] >= least
        done = n
    return on


def _block_edges(reps: np.ndarray, sigs: np.ndarray, x: np.ndarray, y: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """A forest over the pairs of parts x and y that pruning leaves, and over those of the block's least class."""
    hub = int(np.argmin(reps))
    near = _star(sigs, hub)
    a, b = [np.flatnonzero(near)], [np.full(near.sum(), hub)]
    # two rows that are both linked with the hub need no link of their own
    for left, right in [(x[~near[x]], y)] + ([] if same else [(x[near[x]], y[~near[y]])]):
        if len(left) and len(right):
            i, j = surviving(sigs[left], sigs[right], False, THRESHOLD, TOLERANCE)
            a.append(left[i])
            b.append(right[j])
    return _forest(reps[np.concatenate(a)], reps[np.concatenate(b)])


def _candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _by_block(batches):
        reps = table.column("rep").to_numpy()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        lo, hi, side = (table.column(c).to_numpy() for c in ("lo", "hi", "side"))
        out: list[tuple[int, int]] = []
        twos = []
        for a, b in _groups(table):
            if b - a == 2 and lo[a] == hi[a]:
                twos.append(a)
            elif b - a > 1:
                out += _block_edges(reps[a:b], sigs[a:b], *_sides(lo[a:b], hi[a:b], side[a:b]))
        if twos:  # buckets of two, all at once
            at = np.array(twos)
            done = matched = 0
            for n, least in zip(STEPS, least_matches(THRESHOLD, TOLERANCE), strict=True):
                matched = matched + (sigs[at, done:n] == sigs[at + 1, done:n]).sum(1)
                at, matched, done = at[matched >= least], matched[matched >= least], n
            out += zip(np.maximum(reps[at], reps[at + 1]).tolist(), np.minimum(reps[at], reps[at + 1]).tolist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], ["a", "b"])


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """a, b: a forest over the classes (by their `rep`) whose pairs pruning leaves."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda k: F.xxhash64(k, F.substring("sig", k * 2 * ROWS + 1, F.lit(2 * ROWS))))
    held = classes.where("n_shingles > 0").select("rep", F.explode(bands).alias("bucket"))
    # buckets of two or more; of those with the very same members, which close copies make, one
    buckets = (
        held.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("whose"), F.min("rep").alias("least"))
        .where("members > 1").groupBy("members", "whose", "least").agg(F.min("bucket").alias("bucket"))
    )
    members = held.join(buckets.select("bucket", "members"), "bucket").join(classes.select("rep", "sig"), "rep")
    dealt = _blocks(members, "bucket", F.col("members") / _part_size(F.col("members"), BUCKET_PART)).select("slot", "blk", "lo", "hi", "side", "rep", "sig")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartitionById(n, "slot").drop("slot").sortWithinPartitions("blk").mapInArrow(_candidate_edges, "a long, b long")


def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _by_block(batches):
        reps, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        lo, hi, side = (table.column(c).to_numpy() for c in ("lo", "hi", "side"))
        rows: list[tuple] = []
        for a, b in _groups(table):
            if b - a < 2:
                continue
            own = table.slice(a, b - a)
            sets = [np.frombuffer(x, np.uint64) for x in own.column("shingles").to_pylist()]
            sigs = np.frombuffer(b"".join(own.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
            x, y, same = _sides(lo[a:b], hi[a:b], side[a:b])
            i, j = surviving(sigs[x], sigs[y], same, THRESHOLD, TOLERANCE)
            if not len(i):
                continue
            p, q = x[i], y[j]
            common = _overlaps(sets, p, q)
            sizes = np.array([len(s) for s in sets])
            linked = 5 * common >= 4 * (sizes[p] + sizes[q] - common)  # THRESHOLD, in whole numbers
            p, q = p[linked], q[linked]
            n = np.bincount(np.concatenate([p, q]), minlength=b - a)
            weight = np.bincount(np.concatenate([p, q]), np.concatenate([copies[a:b][q], copies[a:b][p]]), minlength=b - a)
            root = dict(_forest(reps[a:b][p], reps[a:b][q]))
            rows += [(int(reps[a + k]), int(n[k]), int(weight[k]), root.get(int(reps[a + k]))) for k in np.flatnonzero(n)]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["rep", "n_classes", "n_documents", "root"])


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = ["rep", "copies", "grp", "parts", "sig"]
    for batch in batches:
        sets = [shingles(x.as_py()).tobytes() for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in own] + [pa.array(sets, pa.binary())], [*own, "shingles"])


def _group_parts(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """rep, grp, parts: the members of candidate groups, and in how many parts their group is compared."""
    sized = groups.join(classes.select("rep", "n_shingles"), groups["node"] == classes["rep"]).select("rep", "grp", "n_shingles")
    sums = sized.groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    parts = F.ceil(F.greatest(F.col("n") / _part_size(F.col("n"), GROUP_PART), F.col("s") / PART_SHINGLES)).cast("long")
    large = saved(sums.select("grp", parts.alias("parts")).where("parts > 1"))
    large = F.broadcast(large) if is_small(large, 100_000) else large
    return sized.join(large, "grp", "left").select("rep", "grp", F.coalesce("parts", F.lit(1)).alias("parts"))


def dealt_groups(docs: DataFrame, classes: DataFrame, groups: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the second comparison: each member of a candidate group, once for each part of its group."""
    members = saved(_group_parts(groups, classes).join(classes.select("rep", "copies", "holder", "sig"), "rep"))
    text = text_of(text_col)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.struct(docs[id_col].alias("doc"), F.xxhash64(text).alias("h")).alias("holder"), text.alias("text"))
    texts = texts.join(members, "holder").dropDuplicates(["rep"]).select("rep", "copies", "grp", "parts", "sig", "text")
    ready = texts.mapInArrow(_with_shingles, "rep long, copies long, grp long, parts long, sig binary, shingles binary")
    return _blocks(ready, "grp", F.col("parts")).select("slot", "blk", "lo", "hi", "side", "rep", "copies", "sig", "shingles")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, h (hash of the text) of each row, and of its class: rep, grp (of its group), least_doc, class_id, copies, and the links.

    Rows without words or without an id have nulls in all but the first two.
    """
    found = saved(sketches(docs, id_col=id_col, text_col=text_col))
    worded = found.where("n_shingles > 0 and doc is not null")
    classes = saved(worded.groupBy("rep").agg(
        F.min("doc").alias("least_doc"), F.first(F.struct("doc", "h")).alias("holder"), F.count("*").alias("copies"),
        F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"),
    ))
    groups = components(candidate_pairs(classes)).withColumnRenamed("component", "grp")
    dealt = dealt_groups(docs, classes, groups, id_col=id_col, text_col=text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = saved(
        dealt.repartitionById(n, "slot").drop("slot").sortWithinPartitions("blk").mapInArrow(_exact_links, "rep long, n_classes long, n_documents long, root long")
    )
    counts = links.groupBy("rep").agg(F.sum("n_classes").alias("n_class_links"), F.sum("n_documents").alias("n_documents"))
    roots = components(links.where("root is not null").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # tables that hot keys are joined with are written first: adaptive execution splits joins of two exchanges only
    linked = roots.select(F.col("node").alias("rep"), "component").join(classes.select("rep", "least_doc"), "rep")
    least = saved(linked.groupBy("component").agg(F.min("least_doc").alias("class_id")))
    by_class = saved(
        classes.select("rep", "least_doc", "copies").join(counts, "rep", "left")
        .join(linked.join(least, "component").select("rep", "component", "class_id"), "rep", "left")
    )
    rep = F.when((F.col("n_shingles") > 0) & F.col("doc").isNotNull(), F.col("rep")).alias("rep")
    return found.select("doc", "h", rep).join(by_class, "rep", "left").withColumn("grp", F.coalesce("component", "rep"))


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id, n_links, n_class_links, copy_id, n_copies.

    copy_id is the least id of the documents with the same shingle set, n_copies their number (the
    document among them); n_class_links is the number of other shingle sets with a similarity of 0.8
    or more, n_links that of other documents: those sets' documents, and the own copies. class_id is
    the least id of all documents that links lead to, directly or through others: the group of near
    duplicates. Texts of fewer than five words are compared as one shingle. Texts without words
    (null and empty ones too) have no shingles and link with nothing; such a document is a class of
    its own. A row without an id is left with a null class and no links. Each row is a document:
    rows of one id and text are copies of each other, rows of one id with other texts are compared
    like any. An empty table gives none; other columns aren't looked at. Shingles are compared by
    64-bit hashes, and so are their sets: of a billion different sets two are taken for one with a
    probability of 3 in a hundred. Two documents that agree in none of 32 bands can be missed, at a
    similarity of 0.8 once in twenty million pairs, and pruning drops a true pair about as rarely
    as the tolerance of 1e-6.
    """
    return _grouped(docs, id_col, text_col).select(
        F.col("doc").alias(id_col),
        F.coalesce("class_id", "least_doc", "doc").alias("class_id"),
        (F.coalesce("n_documents", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("n_class_links", F.lit(0)).cast("long").alias("n_class_links"),
        F.coalesce("least_doc", "doc").alias("copy_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without near duplicates: of each group one row stays, that of the least id (of one id's texts, that of the least hash).

    Groups are those of ngram_jaccard_join(): what links lead to through others goes too, so a
    document that goes can be less like the one that stays than the threshold. Rows without words or
    without an id are in no group and stay, repeated ones too. Columns stay, whatever their names.
    """
    rows = _grouped(docs, id_col, text_col).where("grp is not null").groupBy("doc", "h", "grp").agg(F.count("*").alias("n"))
    rows = saved(rows)
    first = saved(rows.groupBy("grp").agg(F.min(F.struct("doc", "h")).alias("first")))
    first = rows.join(first, "grp").select(F.struct("doc", "h").alias("own"), (F.struct("doc", "h") == F.col("first")).alias("stays"), "n")
    key, stays = fresh("own", docs), fresh("stays", docs)
    marked = saved(first.where("not stays or n > 1").select(F.col("own").alias(key), F.col("stays").alias(stays)))
    own = F.struct(docs[id_col].alias("doc"), F.xxhash64(text_of(text_col)).alias("h"))
    out = docs.join(marked, own == marked[key], "left")
    # of rows that are repeated one stays; all others are not shuffled for it
    repeated = out.where(F.col(stays)).dropDuplicates([key]).select(*[docs[c] for c in docs.columns])
    return out.where(F.col(stays).isNull()).select(*[docs[c] for c in docs.columns]).unionAll(repeated)
