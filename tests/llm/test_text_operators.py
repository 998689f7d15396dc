"""Operators that look at each text by itself, against plain Python or their libraries."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelforge.llm import flac_media, licenses, queries, quality_bayes, quality_rules, sentencepiece_bpe, toxicity, url_filters
from panelforge.llm.license_texts import DIGESTS, TEXTS
from panelforge.llm.tables import table

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def same_as_sql(spark, duck, sf, name):
    df, sql = queries.QUERIES[name](spark, sf), duck.sql(queries.oracle_sql()[name])
    at = [sql.columns.index(c) for c in df.columns]
    plain = lambda r: tuple(repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r)
    assert sorted(plain(r) for r in df.collect()) == sorted(plain([r[i] for i in at]) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, duck, sf, name):
    same_as_sql(spark, duck, sf, name)


def test_encoding_is_the_librarys(spark, sf, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = sentencepiece_bpe.encoder(MODEL)
    rng = random.Random(4)
    pool = ["▁", " ", "  ", "\n", "a", "the", " the", "é", "日本", "🙂", "<0x0A>", "<s>", "\x00", "ing", "tion", "==", "0", "ß"]
    for _ in range(3_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        ids = library.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)
    for df in (table(spark, sf, "documents").limit(60), odd):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for k, r in rows(sentencepiece_bpe.encode_documents(df, MODEL)).items():
            ids = library.encode(texts[k])
            assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_backtracking_equals_merging():
    own = sentencepiece_bpe.encoder(MODEL)
    rng = random.Random(8)
    for _ in range(500):
        text = "".join(rng.choice("▁aeinrst") for _ in range(rng.randint(1, 40)))
        assert own._search(text) == own._merge(text)


def test_media_round_trip_and_damage():
    rng = random.Random(2)
    payloads = [flac_media.payload_of(x) for x in ("", "a", "é" * 40, "the cat sat " * 500)]
    payloads += [rng.randbytes(64 * n) for n in (1, 15, 16, 17, 33)] + [bytes([0, 255] * 64), b"\xff" * 64]
    streams = flac_media.encode_streams(payloads)
    assert flac_media.decode_streams(streams) == payloads
    for p, s in zip(payloads, streams, strict=True):
        for _ in range(4):
            a, n = rng.randrange(len(p)), rng.randrange(1, len(p) + 1)
            assert flac_media.read_samples(s, a, n) == p[a : a + n]
    for _ in range(40):
        broken = bytearray(streams[3])
        broken[rng.randrange(42, len(broken))] ^= 1 << rng.randrange(8)
        with pytest.raises((flac_media.CorruptStream, IndexError)):
            flac_media.decode_streams([bytes(broken)])


def test_media_columns(odd):
    for k, r in rows(flac_media.read_media(flac_media.write_media(odd))).items():
        raw = dict((r["doc_id"], r["text"]) for r in odd.collect())[k]
        raw = (raw or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])


def test_toxic_stems_are_caught(spark, docs):
    rng = random.Random(6)
    stems = ["the", "ing", "er", "on", "and", "re", "st", "ou", "ha", "en"]
    prose = lambda n: " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n))
    ordinary = [prose(rng.randint(20, 200)) for _ in range(400)]
    toxic = [f"{prose(40)} {rng.choice(['zugblik', 'vrumpel'])} {prose(20)} {rng.choice(['zugblik', 'vrumpelan'])}" for _ in range(120)]
    model = toxicity.train(toxic[:80], ordinary[:300])
    test = docs([(i, t) for i, t in enumerate([*toxic[80:], *ordinary[300:]])])
    got = rows(toxicity.score_documents(test, model))
    assert sum(got[i]["predicted"] for i in range(40)) >= 38
    assert sum(got[i]["predicted"] for i in range(40, 140)) <= 2


def test_toxicity_of_odd_texts_and_without_labels(spark, odd):
    flat = toxicity.train([], ["fine"] * 5)
    got = toxicity.score_documents(odd, flat).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] < 0.5 for r in got)
    assert toxicity.score_documents(odd.limit(0), flat).count() == 0


@pytest.mark.parametrize("size, recall, false_alarms", [("sf0.01", 0.6, 0.05), ("sf0.1", 0.5, 0.01)])
def test_toxicity_query_on_held_out_rows_by_class(spark, sf, size, recall, false_alarms):
    """A constant answer fails one of the two."""
    at = sf.replace("sf0.001", size)
    held = queries.op1_toxicity(spark, at).join(table(spark, at, "labels"), "doc_id").where("held_out")
    got = {r["toxic"]: r["p"] for r in held.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert got[1] >= recall and got[0] <= false_alarms


def test_toxicity_of_a_row_without_an_id(spark, odd):
    got = odd.select("doc_id", toxicity.held_out("doc_id").alias("h")).collect()
    assert [r["h"] for r in got if r["doc_id"] is None] == [False] and all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"])


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, sf, odd):
    extra = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "a b c a b c a b c\na b c\na b c"), (21, "x y z w x y z # % |")], "doc_id long, text string"))
    for df in (table(spark, sf, "documents").select("doc_id", "text"), extra):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for k, r in rows(quality_rules.filter_by_rules(df, table(spark, sf, "labels"))).items():
            n = brute_counts(texts[k])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
            assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"])


def test_rules_find_a_planted_threshold(spark):
    rng = random.Random(1)
    data = []
    for i in range(600):
        row = {x: rng.random() for x in quality_rules.STATISTICS}
        data.append((i, int(row["symbol_rate"] > 0.7), *row.values()))
    sample = spark.createDataFrame(data, "doc_id long, rejected int, " + ", ".join(f"{x} double" for x in quality_rules.STATISTICS))
    rules = quality_rules.learn_rules(sample)
    assert rules and rules[0].conditions[0].statistic == "symbol_rate" and rules[0].conditions[0].at_least
    marked = sample.withColumn("rule", quality_rules.rejected_by(rules))
    assert marked.where((F.col("rejected") == 1) & F.col("rule").isNull()).count() < 30
    assert marked.where((F.col("rejected") == 0) & F.col("rule").isNotNull()).count() < 10
    assert quality_rules.learn_rules(sample.where("rejected = 0")) == []


def test_quality_posteriors(spark, sf, odd):
    labels = table(spark, sf, "labels")
    got = quality_bayes.classify_quality(table(spark, sf, "documents"), labels)
    known = got.join(labels, "doc_id")
    assert known.where(F.col("kept") == (F.col("quality") == 1)).count() / known.count() > 0.9
    assert quality_bayes.classify_quality(odd, labels).count() == odd.count()
    assert quality_bayes.classify_quality(odd.limit(0), labels).count() == 0
    unlabelled = quality_bayes.classify_quality(odd, labels.limit(0)).collect()
    assert all(r["quality_score"] == pytest.approx(0.5) for r in unlabelled)


@pytest.mark.parametrize("broadcast_sites", [100_000, 0])
def test_quality_scores_are_those_of_plain_python(spark, sf, broadcast_sites):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    sample = quality_rules.labelled_sample(docs, labels, label=F.when(F.col("quality").isin(0, 1), F.col("quality")), max_rows=20_000)
    base = quality_bayes.fit(quality_rules.with_statistics(sample, repeats=False)).base
    got = quality_bayes.classify_quality(docs, labels, broadcast_sites=broadcast_sites).collect()
    own = [1 / (1 + math.exp(-(r["evidence"] + base))) for r in got]
    host = [(r["source"] or "").split("/")[0] for r in got]
    path = [((r["source"] or ""), r["lang"]) for r in got]

    def sums(keys):
        out = {}
        for k, p in zip(keys, own, strict=True):
            n, s = out.get(k, (0, 0.0))
            out[k] = n + 1, s + p
        return out

    def strength(mean, spread, groups, total):
        noise = mean * (1 - mean)
        return min(max(noise / max(spread - noise * groups / total, noise * 1e-4, 1e-9) - 1, 2.0), 10_000.0)

    hosts, paths, n = sums(host), sums(path), len(got)
    mean = (sum(own) + 0.5) / (n + 1)
    a = strength(mean, sum(k * (s / k - mean) ** 2 for k, s in hosts.values()) / n, len(hosts), n)
    of_host = {h: (a * mean + s) / (a + k) for h, (k, s) in hosts.items()}
    b = strength(mean, sum(k * (s / k - of_host[x[0].split("/")[0]]) ** 2 for x, (k, s) in paths.items()) / n, len(paths), n)
    for r, p, h, x in zip(got, own, host, path, strict=True):
        k, s = paths[x]
        prior = (b * of_host[h] + max(s - p, 0.0)) / (b + k - 1)
        score = 1 / (1 + math.exp(-(r["evidence"] + math.log(prior / (1 - prior)))))
        assert (r["host_posterior"], r["path_posterior"], r["quality_score"]) == pytest.approx((of_host[h], prior, score), rel=1e-6)
        assert r["kept"] == (r["quality_score"] >= 0.5)


def test_bad_sites_pull_their_documents_down(spark, docs):
    """The same text gets a lower score on a site of bad documents than on one of good ones."""
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice(["house", "tree", "river", "walks", "under", "seven"]) for _ in range(80))
    bad = lambda: " ".join(rng.choice(["###", "$$$ %%%", "BUY!!!", "999 999", "***"]) for _ in range(80))
    unsure = "### house tree $$$ river walks BUY!!! under seven " * 9
    rows = [(k, good() if k % 4 else bad(), "fine/a") for k in range(0, 200)] + [(k, bad() if k % 4 else good(), "poor/a") for k in range(200, 400)] + [(900, unsure, "fine/a"), (901, unsure, "poor/a")]
    df = spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int("$" not in t and "#" not in t)) for i, t, _ in rows[:-2]], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_bayes.classify_quality(df, labels).collect()}
    assert got[900]["evidence"] == got[901]["evidence"]
    odds = {k: math.log(got[k]["quality_score"] / (1 - got[k]["quality_score"])) for k in (900, 901)}
    assert odds[900] > odds[901] + 1
    assert got[900]["host_posterior"] > 0.6 > 0.4 > got[901]["host_posterior"]


def brute_rules(rows, bins=24, max_rules=8, max_conditions=3, min_precision=0.97, min_covered=10):
    """Sequential covering in plain Python; rows: (statistics, rejected, grow)."""
    cuts = {}
    for x in quality_rules.STATISTICS:
        found = set()
        for y in (True, False):
            values = sorted(r[0][x] for r in rows if r[1] == y)
            found |= {values[max(math.ceil(i / bins * len(values)) - 1, 0)] for i in range(1, bins)}
        cuts[x] = sorted(found)
    fits = lambda conditions, r: all(r[0][x] >= c if up else r[0][x] <= c for x, up, c in conditions)
    count = lambda rs: (sum(r[1] for r in rs), sum(not r[1] for r in rs))
    rules, left = [], rows
    for _ in range(max_rules):
        grown, conditions = [r for r in left if r[2]], []
        p, n = count(grown)
        while p and n and len(conditions) < max_conditions:
            best, gain_of_best = None, 1e-9
            for x, its in cuts.items():
                for c in its:
                    for up in (True, False):
                        a, b = count([r for r in grown if fits([(x, up, c)], r)])
                        if a and a + b < p + n and (gain := a * (math.log2(a / (a + b)) - math.log2(p / (p + n)))) > gain_of_best:
                            best, gain_of_best = (x, up, c), gain
            if best is None:
                break
            conditions.append(best)
            grown = [r for r in grown if fits([best], r)]
            p, n = count(grown)
        if not conditions:
            break
        tried = []
        for k in range(1, len(conditions) + 1):
            p, n = count([r for r in left if not r[2] and fits(conditions[:k], r)])
            tried.append(((p - n) / (p + n) if p + n else -1.0, -k, p / (p + n) if p + n else 0.0))
        worth, k, precision = max(tried)
        rule = conditions[:-k]
        p, n = count([r for r in left if fits(rule, r)])
        if precision < min_precision or p < min_covered or p < min_precision * (p + n):
            break
        rules.append(rule)
        left = [r for r in left if not fits(rule, r)]
    return rules


@pytest.mark.parametrize("seed", [1, 2])
def test_learned_lists_are_those_of_plain_python(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(400):
        row = {x: round(rng.random(), 3) for x in quality_rules.STATISTICS}
        bad = row["symbol_rate"] > 0.75 or row["mean_word"] < 0.3 and row["upper_rate"] > 0.5 or row["n_words"] > 0.9
        data.append((i, int(bad), *row.values()))
    sample = spark.createDataFrame(data, "doc_id long, rejected int, " + ", ".join(f"{x} double" for x in quality_rules.STATISTICS))
    grow = {r["doc_id"]: r["g"] for r in sample.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("g")).collect()}
    expected = brute_rules([(dict(zip(quality_rules.STATISTICS, r[2:], strict=True)), bool(r[1]), grow[r[0]]) for r in data])
    got = [[(c.statistic, c.at_least, c.threshold) for c in r.conditions] for r in quality_rules.learn_rules(sample)]
    assert got == expected and len(got) >= (2 if seed == 1 else 0)


def test_empty_tables_and_clashing_columns(spark, odd, docs, sf):
    labels = table(spark, sf, "labels")
    none = odd.limit(0)
    assert sentencepiece_bpe.encode_documents(none, MODEL).count() == 0
    assert flac_media.read_media(flac_media.write_media(none)).count() == 0
    assert quality_rules.filter_by_rules(none, labels).count() == 0
    clash = docs([(1, "some words here"), (2, None)]).withColumns({c: F.lit("x") for c in (
        "ids", "n_tokens", "media", "n_bytes", "kept", "rule", "n_words", "evidence", "quality_score", "row", "path", "host", "_text", "_form", "_id", "text_digest", "notice_ids", "symbol_rate")})
    assert {r["doc_id"]: r["n_tokens"] for r in sentencepiece_bpe.encode_documents(clash, MODEL).collect()}[2] == 0
    assert flac_media.read_media(flac_media.write_media(clash)).count() == 2
    assert {r["n_words"] for r in quality_rules.filter_by_rules(clash, labels).collect()} == {0, 3}
    scored = quality_bayes.classify_quality(clash, labels)
    assert len(scored.columns) == len(set(scored.columns)) and {r["row"] for r in scored.collect()} == {"x"} and scored.schema["quality_score"].dataType.simpleString() == "double"
    assert licenses.scan_licenses(clash, *licenses.default_known(spark)).count() == 2


def test_a_long_text_without_spaces_is_encoded_whole():
    import sentencepiece

    rng = random.Random(12)
    text = "".join(rng.choice("aeinrstlo") for _ in range(60_000))
    assert sentencepiece_bpe.encoder(MODEL).encode(text) == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)


def test_rules_of_many_shapes(spark):
    rng = random.Random(4)
    part = lambda n: "".join(rng.choice("ab/") for _ in range(n))
    rules = [(".".join(rng.choice(["a", "b"]) for _ in range(rng.randint(1, 4))), "/" + part(rng.randint(0, 12)), rng.choice(["allow", "block"])) for _ in range(300)]
    urls = ["http://" + ".".join(rng.choice(["a", "b"]) for _ in range(rng.randint(1, 5))) + "/" + part(rng.randint(0, 15)) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    verdicts = {}
    for h, p, v in rules:
        verdicts[h, p] = max(v, verdicts.get((h, p), ""))
    for r in url_filters.judge_urls(pages, url_filters.rule_table(spark, rules)).collect():
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in verdicts.items() if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        best = max(fits, default=None)
        assert (r["rule"], r["verdict"]) == ((best[2], best[3]) if best else (None, "allow"))


def test_sparse_sites_shrink_to_their_prior(spark):
    data = [("big", "big", 0.2)] * 200 + [("fine", "fine", 0.9)] * 200 + [("tiny", "tiny", 0.0)]
    got = rows(quality_bayes.site_posteriors(spark.createDataFrame(data, "host string, path string, p double")), "host")
    assert abs(got["big"]["host_posterior"] - 0.2) < 0.05 and abs(got["fine"]["host_posterior"] - 0.9) < 0.05
    assert got["tiny"]["host_posterior"] > 0.2


def test_licences(spark, docs, odd):
    mit = next(t for k, t in TEXTS if k == "MIT")
    shouted = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ,") + "\n\n\n"
    known = licenses.default_known(spark)
    notices = "Released under the MIT Licence\nLicensed under CC BY-NC 4.0."
    data = [(1, mit), (2, shouted), (3, mit + " and more"), (4, f"Text.\n{notices}"), (5, "Text. Released under the MIT Licence Licensed under CC BY-NC 4.0."), (6, f"Text.\n\n{notices}")]
    df = docs(data)
    got = rows(licenses.scan_licenses(df, *known))
    assert [got[k]["license_id"] for k in range(1, 7)] == ["MIT", "MIT", None, None, None, None]
    # equal words with other line breaks: one whole text, other lines
    assert got[4]["text_digest"] == got[5]["text_digest"] == got[6]["text_digest"]
    assert [got[k]["notice_ids"] for k in (4, 5, 6)] == [["CC-BY-NC-4.0", "MIT"], [], ["CC-BY-NC-4.0", "MIT"]]
    assert rows(licenses.scan_licenses(df, *known, broadcast_rows=0)) == got
    assert rows(licenses.scan_licenses(df, *[k.drop("length") for k in known])) == got
    assert licenses.scan_licenses(odd, *known).where("license_id is not null").count() == 0
    assert licenses.scan_licenses(odd.limit(0), *known).count() == 0
    assert {r["notice_ids"] == [] for r in licenses.scan_licenses(df, known[0], known[1].limit(0)).collect()} == {True}


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_licences_of_repeated_and_shared_digests(spark, docs, broadcast_rows):
    known = licenses.known_digests(spark, [("B", "one whole text"), ("A", "One whole text!"), ("B", "one whole text")])
    notices = licenses.known_digests(spark, [("N", "a notice line"), ("M", "A notice, line"), ("N", "a notice line"), ("L", "another notice")])
    df = docs([(1, "one whole text"), (2, "x\na notice line"), (2, "x\na notice line"), (3, "Another notice.\na notice line\na notice line")])
    got = sorted((r["doc_id"], r["license_id"], r["notice_ids"]) for r in licenses.scan_licenses(df, known, notices, broadcast_rows=broadcast_rows).collect())
    assert got == [(1, "A", []), (2, None, ["M", "N"]), (2, None, ["M", "N"]), (3, None, ["L", "M", "N"])]


def test_spellings_and_planted_texts_of_all_known_licences(spark, docs):
    known = licenses.default_known(spark)
    rng = random.Random(2)
    back = {b: a for a, b in licenses.SPELLINGS if b.strip().isalpha()}
    data, expected = [], {}
    for k, (name, text) in enumerate(TEXTS):
        for b, a in back.items():
            text = text.replace(b, a)
        wrapped = "".join(rng.choice([" ", "\n", "  "]) if c == " " else c for c in text)
        data.append((k, f"Copyright (c) 20{k:02d} Some One\n{wrapped}"))
        expected[k] = name
    got = rows(licenses.scan_licenses(docs(data), *known))
    assert {k: r["license_id"] for k, r in got.items()} == expected


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="the system has no licence texts")
def test_long_licence_texts_are_known(spark, docs):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    data = [(k, open(f"/usr/share/common-licenses/{x}").read().replace("license", "Licence")) for k, x in enumerate(names)]
    got = rows(licenses.scan_licenses(docs(data), *licenses.default_known(spark)))
    assert [got[k]["license_id"] for k in range(len(names))] == list(names.values())


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/GPL-3"), reason="the system has no licence texts")
def test_digests_are_of_the_texts_that_they_name(spark):
    end = "END OF TERMS AND CONDITIONS"
    files = {"Artistic-1.0-Perl": "Artistic", "GPL-1.0-only": "GPL-1", "GPL-2.0-only": "GPL-2", "GPL-3.0-only": "GPL-3", "LGPL-2.0-only": "LGPL-2", "LGPL-3.0-only": "LGPL-3"}

    def part_of(name, part):
        text = open(f"/usr/share/common-licenses/{files.get(name, name.removesuffix('-only'))}").read()
        return {"whole": text, "terms": text.partition(end)[0], "terms and their end line": text.partition(end)[0] + end}[part]

    got = licenses.known_digests(spark, [(name, part_of(name, part)) for name, _, part, _, _ in DIGESTS]).collect()
    assert sorted(map(tuple, got)) == sorted((name, digest, length) for name, _, _, length, digest in DIGESTS)


def test_urls(spark):
    urls = ["http://a.example.org/es/x?y", "HTTPS://EXAMPLE.ORG/en/12#t", "http://example.org", "x", None, "", "http://badexample.org/es/", "http://x.com/de/1", "http://x.net/", "http://example.org/en/2", "://y.org/", "http://y.org?q=/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1)})
    rules = url_filters.rule_table(spark, queries.URL_RULES)
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, rules).collect()}
    assert got == {
        0: ("example.org/es/", "block"), 1: ("example.org/en/1", "block"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"),
        6: ("org/", "allow"), 7: ("com/de/", "block"), 8: (None, "allow"), 9: ("org/", "allow"), 10: ("org/", "allow"), 11: (None, "allow"),
    }
    joined = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge_urls(pages, rules, broadcast_rules=0).collect()}
    assert joined == got
    assert url_filters.judge_urls(pages, rules.limit(0), default="block").where("verdict = 'block'").count() == len(urls)
    assert url_filters.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filters.judge_urls(pages.unionByName(pages), rules).count() == 2 * len(urls)
