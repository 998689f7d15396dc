"""Secret scans against plain Python: matches by `re`, the entropy of each window by itself."""

import hashlib
import math
import random
import re
from collections import Counter

from panelforge.llm import queries, secrets

KEYWORD = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    base = [(m.start(), 0, m.end()) for m in KEYWORD.finditer(text) if len(m[1]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    new = []
    for number, of in enumerate(secrets.CLASSES, 3):
        for m in re.finditer(f"[{of.characters}]+", text):
            run = m[0]
            if not re.search(secrets.MIXED, run) or re.search("|".join(secrets.ALLOWED), run):
                continue
            marked = set()
            for k in range(len(run) - of.window + 1):
                counts = Counter(run[k : k + of.window]).values()
                if -sum(n / of.window * math.log2(n / of.window) for n in counts) > of.bits:
                    marked |= {(k, k + of.window)}
            joined = []
            for a, b in sorted(marked):
                if joined and a <= joined[-1][1]:
                    joined[-1][1] = b
                else:
                    joined.append([a, b])
            new += [(m.start() + a, number, m.start() + b) for a, b in joined]
    every = base + new
    kept = [s for s in every if s[1] < 3 or not any(o[1] < s[1] and o[0] <= s[0] and o[2] >= s[2] for o in every)]
    kinds = [*secrets.BASE_KINDS, *[c.kind for c in secrets.CLASSES]]
    return [(kinds[n], a, b) for a, n, b in sorted(kept)]


def found(df):
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] for r in df.collect()}


def random_text(rng):
    hexes, base64 = "0123456789abcdef", secrets.CLASSES[1].alphabet
    key = lambda pool, a, b: "".join(rng.choice(pool) for _ in range(rng.randint(a, b)))
    piece = [
        lambda: rng.choice(["word", "é", "\U0001f600", "日本", "\n", "AKIA", "ſecret", "toKen"]), lambda: key(hexes, 1, 70), lambda: key(hexes.upper(), 10, 60),
        lambda: key(base64, 10, 90), lambda: key("ab1", 20, 60), lambda: "AKIA" + key("ABC012", 5, 30), lambda: "f81d4fae-7dec-11d0-a765-00a0c91e6bf6",
        lambda: rng.choice(["token", "Password", "API_KEY", "apikey", "secret", "passwd"]) + rng.choice(["=", ": ", "' = \"", '":"', " "]) + key(base64, 1, 20),
        lambda: "path/to/some-long-file/name_of_it", lambda: "A1" * rng.randint(5, 30) + key(base64, 30, 40) + "Z" * 40 + key(base64, 30, 40),
    ]
    return "".join(rng.choice(piece)() + rng.choice(["", " ", ". "]) for _ in range(rng.randint(0, 12)))


def test_spans_are_those_of_plain_python(docs):
    rng = random.Random(12)
    data = [(k, random_text(rng)) for k in range(400)]
    data += [(1000, "token=abc secret: 'secret: abcdefghij"), (1001, "x9" + "Ab3dEf7hIjKl" * 4000), (1002, "token=a " * 3000), (1003, "q" * 100_000)]
    got = found(secrets.scan_secrets(docs(data)))
    assert got == {k: brute_spans(t) for k, t in data}
    assert sum(s[0].startswith("entropy") for x in got.values() for s in x) > 100


def test_odd_texts_and_allow_list(spark, docs, odd):
    got = secrets.scan_secrets(odd).collect()
    assert len(got) == 10 and all(r["secrets"] == [] for r in got) and sum(r["doc_id"] is None for r in got) == 1
    assert secrets.scan_secrets(odd.limit(0)).count() == 0
    key = "kJ8hGfDsAq3WeRt7YuIo9PzXcVbN2m"
    assert found(secrets.scan_secrets(docs([(1, f"é {key}.")]))) == {1: [("entropy_base64", 2, 2 + len(key))]}
    assert found(secrets.scan_secrets(docs([(1, key)]), allowed=["^kJ8"])) == {1: []}
    assert found(secrets.scan_secrets(docs([(1, key)]), classes=())) == {1: []}
    clean = "12345678901234567890123 internationalisation-of-everything 550e8400-e29b-41d4-a716-446655440000 AAAAAAAAAAAAAAAAAAAAAAAA1 /usr/local/share/some/where"
    assert found(secrets.scan_secrets(docs([(1, clean)]))) == {1: []}


def test_query_digests(spark, sf, tmp_path):
    rng = random.Random(5)
    data = [(k, random_text(rng)) for k in range(50)] + [(60, None), (61, "")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op12_secret_scan(spark, str(tmp_path)).collect():
        spans = brute_spans(dict(data)[r["doc_id"]] or "")
        base = [s for s in spans if s[0] in secrets.BASE_KINDS]
        joined = lambda x: ",".join(":".join(map(str, s)) for s in x)
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest() and r["spans"] == joined(spans)
        assert [r[f"n_{k}"] for k in secrets.BASE_KINDS] == [sum(s[0] == k for s in base) for k in secrets.BASE_KINDS]


def test_no_python_and_no_shuffle(spark, sf):
    plan = queries.op12_secret_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
