"""Periodic runs, exact top-k search and centroid clustering against brute force."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrove.llm import clusters, runs, topk, vectors
from lexgrove.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def brute_runs(w, least):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and not any(all(w[i + x] == w[i + x + d] for x in range(size - d)) for d in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def edited(words, doc_id):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def kept_words(words, found):
    out = set()
    for start, length, period in found:
        out |= set(range(start + period, start + length))
    return [w for i, w in enumerate(words) if i not in out]


@pytest.mark.parametrize("few", [0, runs.FEW, 10**9])
def test_runs_of_random_words(few, monkeypatch):
    """Positions taken one by one, by arrays, and both."""
    monkeypatch.setattr(runs, "FEW", few)
    rng = np.random.default_rng(few % 97)
    for _ in range(400):
        docs = []
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(0, 70))
            w = rng.integers(0, rng.integers(1, 5), n)
            if rng.random() < 0.5 and n:
                a, i = int(rng.integers(0, n)), np.arange(n)
                i[a:] = a + (i[a:] - a) % (1 + (n - a) // int(rng.integers(3, 11)))
                w = w[i]
            docs.append(w)
        least, sizes = int(rng.choice([2, 3, 4, 12, 13])), np.array([len(d) for d in docs])
        got = list(zip(*(c.tolist() for c in runs.runs(np.concatenate(docs).astype(np.int64), sizes, least))))
        offsets = np.cumsum(sizes) - sizes
        assert got == [(s + int(o), n, q) for o, d in zip(offsets, docs) for s, n, q in brute_runs(list(d), least)]


def test_fibonacci_words_and_long_periods():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, a and b + a
    got = [tuple(map(int, r)) for r in zip(*runs.runs(np.array(b), np.array([len(b)]), 2))]
    assert got == brute_runs(b, 2) and len(got) > 100
    once = np.arange(5000)
    assert [c.tolist() for c in runs.runs(np.concatenate([once, once, once[:7]]), np.array([10_007]))] == [[0], [10_007], [5000]]


def test_numbers_that_do_not_fit_a_word_are_ordered():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 1 << 30, 500) // 7 for _ in range(3)]
    assert np.array_equal(runs.ordered(*keys), np.lexsort(keys[::-1]))


@pytest.fixture(scope="module")
def texts():
    say = lambda *w: " ".join(w)
    base = ["", None, " \n\t", "a", say(*"ab" * 6), say(*"ab" * 5), "x\x0by\x0cz " * 9, say("start", *("to be or not".split() * 5), "end"), "é 日本 🙂 " * 7, say(*"aab" * 30, *"ba" * 9)]
    return [*base, *base, "word " * 30_000, say(*(str(i * i % 101) for i in range(900)))]


def test_runs_and_collapsed_texts(spark, texts):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(3, texts[7], "", 2), (None, texts[8], "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    got = runs.periodic_runs(docs, batch_bytes=200).collect()
    assert sorted((str(r.doc_id), r.n_words, r.collapsed) for r in got) == sorted((str(i), len(w := (t or "").encode().split()), b" ".join(kept_words(w, [(0, 30_000, 1)] if i == 20 else brute_runs(w, 12))).decode()) for i, t, *_ in rows)
    by = {r.doc_id: [tuple(x) for x in r.runs] for r in got if r.doc_id != 3}
    assert by[20] == [(0, 30_000, 1)] and by[4] == [(0, 12, 2)] and by[5] == [] and by[1] == [] and by[7] == [(1, 20, 4)]
    assert runs.periodic_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, least=1)


def test_the_query_of_runs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_refined_runs"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    tried = 0
    for r in got:
        words = edited([w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id] or "")], r.doc_id)
        if len(words) > 700:
            continue
        found, tried = brute_runs(words, 12), tried + 1
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (best[1] and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept_words(words, found))).hexdigest()
    assert tried > 100 and any(r.n_runs for r in got)


def exact(x, scale):
    return [max(-(1 << 62), min(1 << 62, int(float(c) * scale // 1))) for c in x]


VECTORS = "vec_id long, embedding array<double>, score int, n string"


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in np.round(rng.normal(size=6), 1)], 1, "n") for i in range(-60, 240)]
    rows += [rows[70], rows[70], rows[110], (5, rows[30][1], 1, "n"), (50, [1e6] * 6, 1, "n"), (51, [3e14, -2e15, 1.0, 0.0, 7e12, 0.5], 1, "n"), (100, [1e300, -1e300, 0.0, 0.0, 0.0, 1.0], 1, "n"), (101, [2e9] * 6, 1, "n")]
    rows += [(7, None, 1, "n"), (8, [float("nan")] * 6, 1, "n"), (9, [float("inf"), *[0.0] * 5], 1, "n"), (10, [None, *[1.0] * 5], 1, "n"), (None, [1.0] * 6, 1, "n"), (150, [0.5, 0.25], 1, "n"), (3, [1.0, -1.0], 1, "n"), (200, [], 1, "n"), (250, [0.0] * 6, 1, "n")]
    return rows


def usable(rows):
    return [(r[0], r[1]) for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 40, "block_queries": 2, "fan": 2}])
def test_top_products(spark, odd_vectors, sizes, monkeypatch):
    monkeypatch.setattr(topk, "TILE_ROWS", 17)
    df = spark.createDataFrame(odd_vectors, VECTORS)
    got = [tuple(r) for r in topk.top_products(df, lambda i: i % 50 == 0, **sizes).collect()]
    held, want = [(i, exact(v, 256)) for i, v in usable(odd_vectors) if i is not None], []
    long = (1 << 63) - 1
    for q in {i for i, _ in held if i % 50 == 0}:
        best = {}
        for a in (v for i, v in held if i == q):
            for i, b in held:
                if i != q and len(a) == len(b):
                    s = max(-long, min(long, sum(x * y for x, y in zip(a, b))))
                    best[i] = max(best.get(i, s), s)
        want += [(q, rank + 1, i, s) for rank, (i, s) in enumerate(sorted(best.items(), key=lambda e: (-e[1], e[0]))[:5])]
    assert sorted(got) == sorted(want)
    assert topk.top_products(df.limit(0), lambda i: i % 50 == 0).collect() == []


def test_merging_reaches_all_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-9, 9, 3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    a = topk.top_products(df, lambda i: i < 3, 7, 1, shard_rows=3, fan=2).orderBy("query_id", "rank").collect()
    v = {i: np.array(x).astype(int) for i, x in rows}
    assert [(r.query_id, r.vec_id, r.score) for r in a] == [(q, i, s) for q in range(3) for s, i in sorted(((int(v[q] @ v[i]), i) for i in v if i != q), key=lambda e: (-e[0], e[1]))[:7]]


def brute_clusters(rows, clusters, rounds, dims, scale, seed=1):
    held = [(i, exact(v, scale), v) for i, v in usable(rows) if len(v) == dims]
    digest = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v, _ in sorted(held, key=lambda r: (digest(r[0]), r[2]))[:clusters]]
    for last in [False] * rounds + [True]:
        at = [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v, _ in held]
        if last:
            return sorted((str(i), c, min((1 << 63) - 1, d)) for (i, *_), (d, c) in zip(held, at)), centroids
        for n in range(len(centroids)):
            own = [v for (_, v, _), (_, c) in zip(held, at) if c == n]
            centroids[n] = [sum(x) // len(own) for x in zip(*own)] if own else centroids[n]


@pytest.mark.parametrize("large", [False, True])
def test_clusters(spark, odd_vectors, large):
    rows = [r for r in odd_vectors if large or r[1] is None or max((abs(c or 0) for c in r[1]), default=0) < 9]
    df, scans = spark.createDataFrame(rows, VECTORS), []
    found, centroids = clusters.hamerly(df, 9, 4, 6, 64, scans=scans)
    want, final = brute_clusters(rows, 9, 4, 6, 64)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want and centroids.tolist() == final
    share = [s.agg(F.avg(F.col("scanned").cast("int"))).first()[0] for s in scans]
    assert share[0] == 1.0 and (large or min(share[1:]) < 0.9)


def test_clusters_with_ties_few_vectors_and_none(spark):
    rows = [(i, [float(i % 4), 0.0], 1, "n") for i in range(40)]
    for n, k in ((40, 4), (40, 6), (3, 16)):
        found, centroids = clusters.hamerly(spark.createDataFrame(rows[:n], VECTORS), k, 3, 2, 1)
        want, final = brute_clusters(rows[:n], k, 3, 2, 1)
        assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want and centroids.tolist() == final
    found, centroids = clusters.hamerly(spark.createDataFrame(rows[:0], VECTORS), 4, 3, 2, 1)
    assert found.columns == ["vec_id", "cluster", "distance"] and not found.collect() and not len(centroids)


def test_bounds_hold_and_spare_scans():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-20, 20, (200, 8)) + 300 * rng.integers(0, 2, (1, 8)) for _ in range(6)])
    centroids = v[::200].copy()
    cluster, upper, lower = clusters.scanned(v, centroids)
    for _ in range(4):
        new = np.stack([v[cluster == c].sum(axis=0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centroids[c] for c in range(6)])
        drift = clusters.root(np.diagonal(clusters.distances(new, centroids))) * (1 + clusters.ROOM)
        cluster, upper, lower, full = clusters.reassigned(v, cluster, upper, lower, new, drift)
        centroids = new
        d = np.sqrt(clusters.distances(v, centroids).astype(float))
        assert np.array_equal(cluster, np.argmin(d, axis=1)) and (upper >= d[np.arange(len(v)), cluster]).all()
        d[np.arange(len(v)), cluster] = np.inf
        assert (lower <= d.min(axis=1)).all()
    assert full.mean() < 0.5


def test_integers_and_products():
    x = np.array([[0.5, -0.1, 1e300, -1e300, 4.0e18]])
    assert vectors.integers(x, 1).tolist() == [[0, -1, 1 << 62, -(1 << 62), 4 * 10**18]]
    for most in (10, 1 << 30, 1 << 62):
        v = np.array([[most, -most, 3], [1, most, most - 1]], np.int64)
        assert vectors.product(v, v).tolist() == [[sum(a * b for a, b in zip(r, s)) for s in v.tolist()] for r in v.tolist()]
        assert vectors.square(v).tolist() == [sum(a * a for a in r) for r in v.tolist()]
        assert clusters.unpacked(clusters.packed(v), 3).tolist() == v.tolist()
    assert clusters.unpacked([*clusters.packed(np.array([[1, 2]])), *clusters.packed(np.array([[1 << 40, 2]]))], 2).tolist() == [[1, 2], [1 << 40, 2]]


@pytest.mark.parametrize("name", ["op12_tiled_top_products", "op13_hamerly_clusters"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(tuple(map(str, r)) for r in got.select(*want.columns).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
