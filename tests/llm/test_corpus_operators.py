"""Operators that compare documents, against brute force, and the pipeline."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelforge.llm import components, line_dedup, mixing, ngram_join
from panelforge.llm.tables import table


def near_copies(seed=1, families=6, each=7, words=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
                copy[rng.randrange(words)] = rng.choice(vocabulary)
            out.append(" ".join(copy))
    out += ["one two", "one two", "ONE, two!", "lonely words here", "", "  ", "a b c d e", "a b c d e f"]
    rng.shuffle(out)
    return list(enumerate(out, 10))


def brute_links(data):
    grams = {}
    for i, t in data:
        w = re.findall(r"\w+", (t or "").lower())
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: set() for i in grams}
    for i in grams:
        for j in grams:
            if i < j and grams[i] and grams[j] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                links[i].add(j)
                links[j].add(i)
    group = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = group.get(i, i)
                todo += links[x]
    return links, group


@pytest.mark.parametrize("part", [1_024, 3])
def test_join_finds_all_links(docs, monkeypatch, part):
    monkeypatch.setattr(ngram_join, "BUCKET_PART", (part, 64, part))  # small parts: groups go over many blocks
    monkeypatch.setattr(ngram_join, "GROUP_PART", (part, 64, part))
    data = near_copies()
    links, group = brute_links(data)
    got = {r["doc_id"]: r for r in ngram_join.ngram_jaccard_join(docs(data)).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    assert {i: r["class_id"] for i, r in got.items()} == group


def test_rows_that_share_an_id_keep_their_links(docs):
    base, other = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, base), (5, other), (6, base + " word"), (7, other + " word"), (7, other + " word"), (8, "own words")]
    got = sorted((r["doc_id"], r["n_links"], r["n_class_links"], r["class_id"], r["copy_id"]) for r in ngram_join.ngram_jaccard_join(docs(rows)).collect())
    # each row by itself: 5 twice, of which one has the link of 6, the other those of both rows 7
    assert got == sorted([(5, 1, 1, 5, 5), (5, 2, 1, 5, 5), (6, 1, 1, 5, 6), (7, 2, 1, 5, 7), (7, 2, 1, 5, 7), (8, 0, 0, 8, 8)])


def test_random_ids_with_several_texts(docs):
    rng = random.Random(3)
    data = [(rng.randint(1, 25), t) for _, t in near_copies()]
    links, group = brute_links([(k, t) for k, (_, t) in enumerate(data)])
    least = {}
    for k, g in group.items():
        least[g] = min(least.get(g, 10**9), data[k][0])
    got = sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in ngram_join.ngram_jaccard_join(docs(data)).collect())
    assert got == sorted((data[k][0], len(links[k]), least[group[k]]) for k in links)


def test_one_of_each_group_stays(docs, odd):
    base, other = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(5, base), (5, other), (6, base + " word"), (7, other + " word"), (7, other + " word"), (8, "own words"), (9, "own words"), (9, "own words"), (4, "x y"), (4, "x y")]
    got = sorted((r["doc_id"], r["text"]) for r in ngram_join.one_of_each_group(docs(rows)).collect())
    assert got == sorted([(5, base), (5, other), (8, "own words"), (4, "x y")])
    kept = ngram_join.one_of_each_group(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "8", "None"])
    assert ngram_join.one_of_each_group(odd.limit(0)).count() == 0


def test_a_large_group_is_dealt_in_few_copies(spark, docs):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    data = []
    for i in range(2_000):
        words = list(base)
        words[rng.randrange(60)] = f"x{i}"
        data.append((i, " ".join(words)))
    df = docs(data)
    found = ngram_join.sketches(df)
    classes = found.groupBy("rep").agg(F.first(F.struct("doc", "h")).alias("holder"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")).cache()
    groups = classes.select(F.col("rep").alias("node"), F.lit(1).cast("long").alias("grp"))
    dealt = ngram_join.dealt_groups(df, classes, groups)
    assert classes.count() == 2_000 and dealt.count() == 10 * 2_000
    # the 55 blocks of its ten parts go to as many partitions
    tasks = [r["count"] for r in dealt.groupBy(F.pmod("slot", F.lit(211))).count().collect()]
    assert len(tasks) == 55 and max(tasks) < 2 * 260


def test_overlaps_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(40)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(20), np.arange(10, 40)))
    assert ngram_join._overlaps(sets, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]


def test_join_on_the_tables(spark, sf):
    df = table(spark, sf, "documents")
    links, group = brute_links([(r["doc_id"], r["text"]) for r in df.collect()])
    got = {r["doc_id"]: r for r in ngram_join.ngram_jaccard_join(df).collect()}
    assert {i: (r["n_links"], r["class_id"]) for i, r in got.items()} == {i: (len(links[i]), group[i]) for i in links}


def test_join_of_odd_rows(odd):
    got = ngram_join.ngram_jaccard_join(odd).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"]} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}
    assert all(r["n_links"] == 0 for r in got if r["doc_id"] in (1, 2, 3, 4, 5))
    assert ngram_join.ngram_jaccard_join(odd.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    least = ngram_join.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least) and least[-1] < 0.8 * 128 and least[-1] > 64


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(x, i) for x in (1_000, 2_999) for i in range(1_001, 2_000)] + [(500, 500)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_blocks(mine, others, words, min_words=5):
    """Lines of `mine` in a run of lines that count, of `min_words` words or more, that `others` has too."""
    gone = set()
    for a in range(len(mine)):
        for b in range(len(others)):
            n = 0
            while a + n < len(mine) and b + n < len(others) and mine[a + n] == others[b + n] != 0:
                n += 1
            if sum(words[a : a + n]) >= min_words:
                gone |= set(range(a, a + n))
    return gone


def test_alignment_finds_every_block():
    rng = random.Random(5)
    for k in range(400):
        size = {i: rng.choice([1, 1, 2, 3, 6]) for i in range(13)}
        a, b = ([rng.randint(0, 12 if k % 2 else 4) for _ in range(rng.randint(0, 40))] for _ in range(2))
        sides = [line_dedup.Lines.of(np.array(x, np.int64), np.array([size[i] for i in x], np.int64), 5) for x in (a, b)]
        blocks = line_dedup.aligned_blocks(*sides)
        assert all(a[i : i + n] == b[j : j + n] and 0 not in a[i : i + n] and sum(size[x] for x in a[i : i + n]) >= 5 for i, j, n in blocks)
        assert {i + m for i, _, n in blocks for m in range(n)} == brute_blocks(a, b, [size[i] for i in a])


def test_alignment_of_unique_lines_is_difflibs():
    rng = random.Random(6)
    for _ in range(100):
        a = rng.sample(range(1, 60), 25)
        b = [x for x in a if rng.random() < 0.8]
        for _ in range(4):
            b.insert(rng.randrange(len(b) + 1), rng.randint(100, 999))
        sides = [line_dedup.Lines.of(np.array(x, np.int64), np.full(len(x), 9), 5) for x in (a, b)]
        assert line_dedup.aligned_blocks(*sides) == [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]


def plain_patience(a, b):
    """Places of the textbook's patience diff, by recursion: equal ends, the longest chain of symbols that are once
    on either side (of the first ones, where none is), and what lies between its links.
    """
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in plain_patience(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return plain_patience(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 and b.count(x) == 1]
    anchors = once or [(i, b.index(x)) for i, x in enumerate(a) if x in b and a.index(x) == i]
    chains = []
    for i, j in anchors:
        chains.append(max((c for c in chains if c[-1][1] < j), key=len, default=[]) + [(i, j)])
    chain = max(chains, key=len, default=[])
    if not once or not chain:
        return chain
    out, i0, j0 = [], 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        out += [(i0 + x, j0 + y) for x, y in plain_patience(a[i0:i], b[j0:j])] + ([(i, j)] if i < len(a) else [])
        i0, j0 = i + 1, j + 1
    return out


def plain_aligned_lines(mine, others, words, min_words=5):
    """Lines of `mine` in runs that patience diffs of runs, each of what is left, align with `others`."""
    def runs(x, size):
        out = []
        for k in range(len(x)):
            n = 1
            while k + n <= len(x) and x[k + n - 1] and sum(size[k : k + n]) < min_words:
                n += 1
            whole = k + n <= len(x) and all(x[k : k + n])
            out.append(tuple(x[k : k + n]) if whole else None)
        return out

    def size_of(x):
        return [words[i] for i in x]

    gone = set()
    for turn in (lambda x: x, lambda x: x[::-1]):
        a, b = turn(mine), turn(others)
        ra, rb = runs(a, size_of(a)), runs(b, size_of(b))
        both = {*ra} & {*rb} - {None}
        left, rb = [k for k, r in enumerate(ra) if r in both], [r for r in rb if r in both]
        while left:
            found = {left[i] for i, _ in plain_patience([ra[k] for k in left], rb)}
            if not found:
                break
            for k in found:
                gone |= set(turn(range(len(mine)))[k : k + len(ra[k])])
            left = [k for k in left if k not in found]
    return gone


def test_alignment_is_that_of_plain_patience():
    rng = random.Random(15)
    for k in range(300):
        size = {i: rng.choice([1, 2, 3, 6]) for i in range(13)} | {0: 0}
        a = [rng.randint(0, 12 if k % 2 else 5) for _ in range(rng.randint(0, 25))]
        b = rng.sample(a, len(a)) if k % 3 == 0 else a[10:] + a[:10] if k % 3 == 1 else [rng.randint(0, 12) for _ in range(20)]
        sides = [line_dedup.Lines.of(np.array(x, np.int64), np.array([size[i] for i in x], np.int64), 5) for x in (a, b)]
        got = {i + m for i, _, n in line_dedup.aligned_blocks(*sides) for m in range(n)}
        assert got == plain_aligned_lines(a, b, size)


def test_one_alignment_is_that_of_plain_patience():
    rng = random.Random(16)
    for _ in range(500):
        a, b = ([rng.randint(1, 9) for _ in range(rng.randint(0, 18))] for _ in range(2))
        got = sorted(line_dedup._patience(a, b))
        assert len({i for i, _ in got}) == len(got) and all(a[i] == b[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:]))  # rising in both
        x, y = (rng.sample(range(1, 25), 18) for _ in range(2))
        assert len(line_dedup._patience(x, y)) == len(plain_patience(x, y))  # no ties but among chains of one length


@pytest.mark.parametrize("n", [30, 200])
def test_reversed_lists_align_run_by_run(n):
    x = np.arange(1, n + 1)
    sides = [line_dedup.Lines.of(y, np.full(n, 9), 5) for y in (x, x[::-1].copy())]
    assert sorted(line_dedup.aligned_blocks(*sides)) == [(i, n - 1 - i, 1) for i in range(n)]


def test_nothing_goes_but_by_alignment(docs, monkeypatch):
    data = [(1, "one two three four five\nsix seven eight nine ten"), (2, "six seven eight nine ten\nan own line of this document\none two three four five")]
    assert {r["doc_id"]: r["n_deleted"] for r in line_dedup.dedup_lines(docs(data)).collect()} == {1: 0, 2: 2}
    sides = [line_dedup.Lines.of(np.array(x), np.full(len(x), 9), 5) for x in ([1, 2, 3, 4], [9, 1, 2, 4, 3])]
    assert sum(n for *_, n in line_dedup.aligned_blocks(*sides)) == 4
    monkeypatch.setattr(line_dedup, "_patience", lambda a, b: [])
    assert line_dedup.aligned_blocks(*sides) == []


def test_lines_go_from_the_later_document(docs):
    passage = "a passage of more than five words that repeats\nand its second line with many words too"
    data = [(1, f"first opening line is here now\n{passage}\nend"), (2, f"second document starts with this line\n{passage}"), (3, passage), (4, "short\nend"), (5, "first opening line is here now  \nits own words follow in here")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(data)).collect()}
    assert got[1]["text"] == data[0][1] and got[1]["n_deleted"] == 0
    assert got[2]["text"] == "second document starts with this line" and got[2]["n_deleted"] == 2
    assert got[3]["text"] == "" and got[4]["text"] == "short\nend"
    assert got[5]["text"] == "its own words follow in here"


def test_no_line_is_lost(spark, sf):
    df = table(spark, sf, "documents")
    before = {x.strip() for r in df.collect() for x in r["text"].split("\n")}
    done = line_dedup.dedup_lines(df).collect()
    after = {x.strip() for r in done for x in r["text"].split("\n")}
    assert before - after <= {""} and len(done) == df.count()
    held = {}
    for r in sorted(done, key=lambda r: r["doc_id"]):
        for x in {x.strip() for x in r["text"].split("\n") if len(x.split()) >= 30}:
            held.setdefault(x, []).append(r["doc_id"])
    assert all(len(v) == 1 for v in held.values())


def test_line_dedup_of_odd_rows(odd):
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == odd.count() and {r["doc_id"]: r["text"] for r in got if r["doc_id"] == 1} == {1: None}
    assert {r["doc_id"]: r["text"] for r in got}[7] == "" and [r["text"] for r in got if r["doc_id"] is None] == ["a b c d e f"]
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


NOT_LATIN = [
    "привет мир это длинная строка", "αυτή είναι μια μεγάλη γραμμή", "هذا سطر طويل من خمس كلمات", "यह एक लंबी पंक्ति है यहाँ",
    "这是一行没有空格的很长的文字", "これは空白のない長い行です", "นี่คือบรรทัดยาวที่ไม่มีช่องว่าง",
]


@pytest.mark.parametrize("line", NOT_LATIN)
def test_lines_of_all_scripts_go(docs, line):
    data = [(1, line), (2, f"own words of the second text\n{line}\n一二\n***"), (3, "一二\n***")]
    got = {r["doc_id"]: (r["text"], r["n_deleted"]) for r in line_dedup.dedup_lines(docs(data)).collect()}
    assert got == {1: (line, 0), 2: ("own words of the second text\n一二\n***", 1), 3: ("一二\n***", 0)}


def test_words_of_a_line(spark):
    lines = {"one  two\tthree ": 3, "a - b, c!": 4, "": 0, "你好，世界。": 2, "スーパー": 2, "abc 中文 x": 3, "ภาษาไทย": 2, "çà là": 2}
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert {r["line"]: r["n"] for r in df.select("line", line_dedup.word_count(F.col("line")).alias("n")).collect()} == lines


def test_pipeline_keeps_what_is_left_in_any_script(spark, docs):
    data = [(1, "an english line of more than five words"), (2, "an english line of more than five words\nпривет мир"), (3, "an english line of more than five words\n***")]
    kept = corpus_pipeline.dedup_lines(spark, docs(data), "").collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: data[0][1], 2: "привет мир"}


def brute_line_dedup(data, min_words=5):
    """Every document, one for each text of an id, aligned with every earlier one by a plain patience diff; the order of one id's texts is given."""
    lines, number = {k: t.split("\n") for k, t in data}, {}
    hashes = {k: [number.setdefault(x.strip(), len(number) + 1) if re.search(r"\w", x) else 0 for x in v] for k, v in lines.items()}
    out = {}
    for i, mine in lines.items():
        words = {h: len(x.split()) for j in lines for h, x in zip(hashes[j], lines[j], strict=True)}
        gone = set().union(*(plain_aligned_lines(hashes[i], hashes[j], words, min_words) for j in lines if j < i))
        out[i] = "\n".join(x for k, x in enumerate(mine) if k not in gone)
    return out


def by_text(spark, rows):
    """(id, hash of the text) -> text before, in the order in which one id's texts count as earlier and later."""
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.xxhash64("t").alias("h"), "t")
    return {(r["id"], r["h"]): r["t"] for r in df.collect()}


def test_passages_of_short_lines_go(docs):
    data = [(1, "a b c"), (2, "d e f"), (10, "a b c\nd e f"), (11, "a b c"), (12, "d e f"), (20, "a b c\nd e f")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs(data)).collect()}
    assert got == brute_line_dedup(data) and got[20] == "" and got[10] == data[2][1]


@pytest.mark.parametrize("repeats", [False, True])
def test_line_dedup_is_that_of_all_pairs(spark, docs, repeats):
    rng = random.Random(11)
    pool = [" ".join(f"{x}{k}" for k in range(rng.choice([1, 1, 2, 2, 3, 4, 6]))) for x in "abcdefghijklmnopqrstuvwxyz"] + ["", "***"]
    passages = [rng.sample(pool, rng.randint(2, 6)) for _ in range(40)]
    data = []
    for i in range(1, 161):
        lines = [x for p in rng.sample(passages, 3) for x in p]
        if repeats:  # lines again, in any order, a hot line, and ids with several texts
            lines += [rng.choice(lines) for _ in range(rng.randint(0, 8))] + ["a line that a third of all has"] * rng.choice([0, 0, 1, 3])
        data.append((i if not repeats else rng.randint(1, 80), "\n".join(lines)))
    before = by_text(spark, data)
    expected = brute_line_dedup(list(before.items()))
    got = line_dedup.dedup_lines(docs(data)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((k[0], expected[k]) for i, t in data for k in before if k[0] == i and before[k] == t)


def test_no_unique_line_goes_where_texts_share_an_id(docs):
    data = [(1, "alpha beta gamma delta epsilon zeta"), (9, "alpha beta gamma delta epsilon zeta"), (9, "totally different words in here now\nalpha beta gamma delta epsilon zeta"), (9, "alpha beta gamma delta epsilon zeta")]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs(data)).collect())
    assert got == [(1, data[0][1]), (9, ""), (9, ""), (9, "totally different words in here now")]


def test_line_dedup_replaces_its_own_columns_and_keeps_others(docs):
    df = docs([(1, "one two three four five"), (2, "one two three four five")]).withColumns({c: F.lit("x") for c in ("n_lines", "n_deleted", "key", "gone", "doc", "hashes", "words")})
    got = line_dedup.dedup_lines(df)
    assert {r["doc_id"]: (r["n_lines"], r["n_deleted"], r["key"], r["gone"], r["doc"]) for r in got.collect()} == {1: (1, 0, "x", "x", "x"), 2: (1, 1, "x", "x", "x")}


def marginals(cells, keep=0.5):
    """(dimension, value) -> tokens and the share of them that is wanted, uncapped."""
    out = {}
    for k, d in enumerate(mixing.DIMENSIONS):
        sums = {}
        for c in cells:
            sums[c[k]] = sums.get(c[k], 0) + c[3]
        powered = {v: n ** mixing.POWERS[d] for v, n in sums.items()}
        out |= {(d, v): (sums[v], keep * sum(sums.values()) * x / sum(powered.values())) for v, x in powered.items()}
    return out


CELLS = "source string, lang string, topic string, n long"


@pytest.mark.parametrize("broadcast_cells", [100_000, 0])
def test_raking_meets_the_marginals(spark, broadcast_cells):
    rng = random.Random(2)
    cells = [(s, lang, t, rng.randint(1, 5000)) for s in ("a", "b", "c", None) for lang in ("en", "de") for t in ("prose", "list")]
    df, report = mixing.rake(spark.createDataFrame(cells, CELLS), broadcast_cells=broadcast_cells)
    got = {(r["dimension"], r["value"]): r for r in report.collect()}
    for key, (available, wanted) in marginals(cells).items():
        assert wanted < available and got[key]["target"] == pytest.approx(wanted) and got[key]["expected"] == pytest.approx(wanted, rel=1e-6)
    assert all(0 < r["x"] <= r["n"] for r in df.collect()) and df.count() == len(cells)


def test_raking_cuts_cells_at_their_tokens_and_still_meets_the_marginals(spark):
    """Sources coupled to languages, of which some cells would need more tokens than they have."""
    cells = [
        (s, lang, "prose", n if lang == main else n // 8)
        for s, main, n in (("hot", "en", 540_000), ("b", "de", 150_000), ("c", "de", 90_000), ("d", "en", 200_000)) for lang in ("en", "de")
    ]
    df, report = mixing.rake(spark.createDataFrame(cells, CELLS))
    assert any(r["x"] > 0.999 * r["n"] for r in df.collect())
    for r in report.collect():
        assert r["target"] == pytest.approx(r["wanted"]) and r["expected"] == pytest.approx(r["wanted"], rel=1e-6)


def test_values_that_lack_tokens_are_taken_whole_and_reported(spark):
    cells = [(s, lang, t, n) for s in "ab" for lang in ("en", "de") for t, n in (("prose", 10_000), ("list", 40))]
    given = {"topic": spark.createDataFrame([("prose", 0.9), ("list", 0.1)], "value string, share double")}
    df, report = mixing.rake(spark.createDataFrame(cells, CELLS), given=given)
    got = {r["value"]: r for r in report.where("dimension = 'topic'").collect()}
    assert got["list"]["wanted"] > got["list"]["available"] == got["list"]["target"] == 160 and got["list"]["expected"] == pytest.approx(160)
    assert got["prose"]["expected"] == pytest.approx(0.5 * 40_160 - 160)
    assert sum(r["x"] for r in df.collect()) == pytest.approx(0.5 * 40_160)


def test_raking_reports_targets_that_cannot_be_met_together(spark):
    cells = spark.createDataFrame([("a", "en", "prose", 900), ("b", "de", "prose", 100)], CELLS)
    given = {"source": spark.createDataFrame([("a", 0.5), ("b", 0.5)], "value string, share double"), "lang": spark.createDataFrame([("en", 0.9), ("de", 0.1)], "value string, share double")}
    with pytest.warns(UserWarning, match="off its target"):
        df, report = mixing.rake(cells, keep=0.1, given=given)
    assert df.count() == 2 and max(abs(r["expected"] / r["target"] - 1) for r in report.collect()) > 0.1


def test_expected_sample_has_the_target_shares(spark, sf):
    mixed = mixing.mix_sources(table(spark, sf, "documents")).persist()
    cells = [tuple(r) for r in mixed.where("n_tokens > 0").groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens")).collect()]
    for (d, v), (available, wanted) in marginals(cells).items():
        got = mixed.where(F.col(d).eqNullSafe(v)).agg(F.sum(F.col("n_tokens") * F.col("probability"))).first()[0]
        if wanted > available:
            assert got == pytest.approx(available, rel=1e-3)
        elif d != "topic":  # of which some lack tokens, so that others make up for them
            assert got == pytest.approx(wanted, rel=1e-3)
    mixed.unpersist()


def test_mixing_replaces_its_own_columns(spark, docs):
    df = docs([(k, "some words of prose " * 30) for k in range(20)]).withColumns({c: F.lit("x") for c in ("topic", "n_tokens", "rate", "probability", "sampled", "p", "off", "t_source", "_x")})
    got = mixing.mix_sources(df)
    assert len(got.columns) == len(df.columns) and {r["topic"] for r in got.collect()} == {"prose"} and {r["off"] for r in got.collect()} == {"x"}
    by_column = mixing.mix_sources(df, topic=F.col("line"))
    assert {r["topic"] for r in by_column.collect()} == {"x"}


def test_given_shares_and_the_sample(spark, sf, odd):
    given = {"lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "value string, share double")}
    got = mixing.mix_sources(table(spark, sf, "documents"), keep=0.1, given=given)
    sums = {r["lang"]: r["w"] for r in got.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("w")).collect()}
    assert sums["fr"] == 0 and sums["es"] == 0 and sums["en"] == pytest.approx(sums["de"], rel=1e-3)
    mixed = mixing.mix_sources(odd).collect()
    assert len(mixed) == odd.count() and not any(r["sampled"] for r in mixed if r["doc_id"] in (1, 2, 3))
    assert mixing.mix_sources(odd.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark, sf):
    d = sf.replace("sf0.001", "sf0.01")
    raw = table(spark, d, "documents")
    kept = corpus_pipeline.quality(spark, raw, d).cache()
    labels = table(spark, d, "labels")
    good = labels.where("quality = 1")
    assert kept.join(good, "doc_id").count() >= 0.97 * good.join(raw, "doc_id").count()
    lines = corpus_pipeline.dedup_lines(spark, kept, d).cache()
    assert set(lines.columns) == set(raw.columns) and lines.where("n_chars <> length(text)").count() == 0
    near = corpus_pipeline.near_duplicates(spark, lines, d).cache()
    _, group = brute_links([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert sorted(r["doc_id"] for r in near.collect()) == sorted(set(group.values()))
    mixed = corpus_pipeline.mix(spark, near, d).cache()
    assert 0 < mixed.count() < near.count() and set(mixed.columns) == set(raw.columns)
    final = corpus_pipeline.encode(spark, mixed, d)
    assert final.count() == mixed.count() and final.where("n_tokens <> size(ids)").count() == 0


def test_pipeline_runs_as_one(spark, sf):
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, sf).where("n_tokens > 0").count() > 0
