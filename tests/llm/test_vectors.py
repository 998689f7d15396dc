"""Whitening and clustering of embeddings against plain Python in whole numbers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import centroids, exact, queries, whitening

NAN, INF = float("nan"), float("inf")


@pytest.fixture
def vectors(spark):
    """Builds an embeddings table of (vec_id, embedding) pairs, with columns that clash with internal names."""
    def of(rows, kind="float"):
        return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, v string")

    return of


def draw(rng, n, d, spread=None):
    spread = spread or [1.0 + k for k in range(d)]
    base = [[rng.gauss(0, s) + 3 for s in spread] for _ in range(n)]
    return [[float(np.float32(x + 0.5 * y)) for x, y in zip(row, row[1:] + row[:1])] for row in base]


def test_digits_and_limbs_give_back_integers():
    rng = random.Random(1)
    for bits in (1, 17, 31, 32, 33, 62, 63, 64, 200):
        x = [rng.randrange(-(1 << bits), 1 << bits) for _ in range(40)] + [0, -1, -(1 << bits), (1 << bits) - 1]
        y = np.array(x, dtype=object) if bits > 60 else np.array(x)
        assert [sum(int(d[i]) << (32 * k) for k, d in enumerate(exact.digits(y))) for i in range(len(x))] == x
        assert [sum(int(d[i]) << (18 * k) for k, d in enumerate(whitening.limbs(y))) for i in range(len(x))] == x
    assert exact.from_digits([("a", 1, 3), ("a", 0, -5)]) == {"a": 3 * 2**32 - 5}


@pytest.mark.parametrize("bits", [5, 17, 19, 40, 90])
def test_products_are_exact(bits):
    rng = random.Random(bits)
    y = [[rng.randrange(-(1 << bits), 1 << bits) for _ in range(5)] for _ in range(60)]
    got = whitening.exact_gram(np.array(y, dtype=object if bits > 60 else np.int64))
    assert got.tolist() == [[sum(r[i] * r[j] for r in y) for j in range(5)] for i in range(5)]


def brute_whitening(rows, components):
    """Whole numbers up to the covariance, of (id, vector) pairs that are all kept."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    y = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return n, [sum(a * a for a in r) for r in y], np.array(y, float) / n @ axes / np.sqrt(values), values / np.trace(v)


def by_vector(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    return out


def test_whitening_is_that_of_plain_python(vectors):
    rng = random.Random(2)
    data = list(enumerate(draw(rng, 90, 6)))
    odd = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (102, [NAN] * 6), (103, [INF] * 6), (104, []), (105, [1.0, 2.0]), (106, [-INF, 0.0, 0.0, 0.0, 0.0, 0.0])]
    for df in (vectors(data + odd), vectors(data + odd).repartition(7), vectors(data + odd, "double")):
        got = by_vector(whitening.whiten(df, components=4))
        n, deviation, z, explained = brute_whitening(data, 4)
        assert set(got) == {i for i, _ in data}
        own = np.array([[got[i][c][0]["whitened"] for c in range(1, 5)] for i, _ in data])
        assert np.allclose(np.abs(own), np.abs(z), atol=1e-9) and np.allclose(np.abs((own * z).mean(0)), 1)
        for (i, _), d in zip(data, deviation, strict=True):
            assert all(got[i][c][0]["deviation"] == d and got[i][c][0]["n"] == n for c in range(1, 5))
        r = got[0]
        assert np.allclose([r[c][0]["explained"] for c in range(1, 5)], explained, rtol=1e-9) and 0 <= r[1][0]["identity_error"] < 1e-9


def test_whitening_of_large_numbers_repeats_and_few_rows(vectors, spark):
    rng = random.Random(3)
    far = [[x * 1e15 for x in v] for v in draw(rng, 40, 3)]
    rows = [(1, far[0]), (1, far[0]), (None, far[1]), *enumerate(far, 10)]
    got = whitening.whiten(vectors(rows, "double"), components=3).collect()
    n, deviation, _, _ = brute_whitening(rows, 3)
    assert len(got) == 3 * len(rows) and got[0]["identity_error"] < 1e-6
    assert sorted(r["deviation"] or 0 for r in got) == sorted(d if d < 10**38 else 0 for d in deviation for _ in range(3))
    # three alike vectors have no variance; two have one component
    same = whitening.whiten(vectors([(k, [1.0, 2.0]) for k in range(3)])).collect()
    assert len(same) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 for r in same)
    two = whitening.whiten(vectors([(1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert [(r["component"], abs(r["whitened"]) if r["whitened"] is not None else None) for r in two] == [(1, 1.0), (2, None)] * 2
    assert whitening.whiten(vectors([])).count() == 0 and whitening.whiten(vectors([(1, None), (2, [])])).count() == 0
    assert whitening.whiten(vectors([(1, [1.0])])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_whitening_query(spark, sf):
    got = queries.op11_whitening(spark, sf).toPandas()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    n, deviation, z, explained = brute_whitening(rows, 32)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    # axes are the same but for their signs
    assert np.allclose(np.abs((wide * z).mean(0)), 1, atol=1e-9) and np.allclose(wide.T @ wide / n, np.eye(32), atol=1e-9)
    assert got.groupby("vec_id")["deviation"].first().tolist() == deviation and (got["n"] == n).all()
    assert np.allclose(got.groupby("component")["explained"].first(), explained, rtol=1e-9) and got["identity_error"].max() < 1e-9


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(64 * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    digest = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centres = [x for _, x in sorted(kept, key=digest)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(centres)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    inertia = {j: sum(d for _, c, d in found if c == j) for j in range(len(centres))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in found), key=str)


def clusters(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e7])
def test_clusters_are_those_of_plain_python(vectors, scale):
    rng = random.Random(4)
    data = [(k, [x * scale for x in v]) for k, v in enumerate(draw(rng, 120, 10))]
    data += [(200, data[5][1]), (200, data[5][1]), (7, data[8][1]), (None, data[9][1]), (300, [0.0] * 10), (301, [0.0] * 10)]
    odd = [(401, None), (402, [1.0] * 9), (403, [NAN] * 10), (404, [None] * 10), (405, []), (406, [INF] + [0.0] * 9)]
    got, _ = centroids.cluster(vectors(data + odd, "double").repartition(5), dim=10, k=9)
    want = brute_clusters(data, 9, 3, 10)
    beyond = lambda r: tuple(None if isinstance(x, int) and x >= 1 << 63 else x for x in r)
    assert clusters(got) == [(i, j, *beyond((d, None if any(beyond(r)[2] is None for r in want if r[1] == j) else s, None if any(beyond(r)[2] is None for r in want) else t)), h) for i, j, d, s, t, h in want]


def test_odd_clusterings(vectors):
    rng = random.Random(5)
    few = [(k, v) for k, v in enumerate(draw(rng, 3, 10))]
    assert clusters(centroids.cluster(vectors(few), dim=10)[0]) == brute_clusters(few, 16, 3, 10)
    same = [(k, [1.5] * 10) for k in range(40)]
    got = clusters(centroids.cluster(vectors(same), dim=10)[0])
    assert got == brute_clusters(same, 16, 3, 10) and {r[1] for r in got} == {0}
    for none in ([], [(1, None)], [(1, [1.0])]):
        assert centroids.cluster(vectors(none), dim=10)[0].count() == 0
    # longs end before these squares do: assigned exactly, with no distance
    far = [(k, [(-1) ** k * 1e12 * (k + 1)] * 10) for k in range(8)]
    got = centroids.cluster(vectors(far, "double"), dim=10, k=2)[0].collect()
    assert len(got) == 8 and any(r["distance"] is None for r in got) and all(r["inertia"] is None for r in got)
    assert [(r[0], r[1]) for r in brute_clusters(far, 2, 3, 10)] == sorted((r["vec_id"], r["cluster"]) for r in got)


def test_screening_spares_distances(vectors, monkeypatch):
    rng = random.Random(6)
    # families that differ in which segments are large: their norms tell them apart
    data = [(k, [rng.gauss(0, 40 if i // 4 == k % 5 else 1) for i in range(20)]) for k in range(300)]
    got = centroids.cluster(vectors(data), dim=20, k=10)[0]
    assert clusters(got) == brute_clusters([(i, [float(np.float32(x)) for x in v]) for i, v in data], 10, 3, 20)
    assert got.agg(F.avg("n_exact")).first()[0] < 5
    monkeypatch.setattr(centroids, "CELLS", 50)
    norms = lambda x: centroids.segment_norms(x, 4)
    x = np.array([v for _, v in data]).astype(np.int64)
    a, b = centroids.nearest(x, norms(x), x[:10], 4), ((x[:, None] - x[None, :10]) ** 2).sum(2)
    assert (a[0] == b.argmin(1)).all() and (a[1] == b.min(1)).all()


def test_centroid_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert clusters(queries.op13_centroids(spark, sf)) == brute_clusters(rows, 16, 3, 64)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from panelforge.llm import tables

    made = []
    def session(master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else "w"))

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables._shared_folder(session(master))
    assert tables._shared_folder(session("yarn", "hdfs://x")) == "hdfs://x"
    made.clear()
    assert tables._shared_folder(session("local[4]")) == "w/checkpoints"
