import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import va_clustering as V

SF001 = "/root/testdata/sf0.001"


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    centroids = [v for _, v in first[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else centroids[j] for j, g in enumerate(groups)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in last if c == j) for j in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for i, d, c in last), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, page string, cells int")


def test_equals_brute_force(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert rows_of(V.clusters_digest(df)) == brute(rows)


def test_odd_vectors(spark):
    r = random.Random(5)
    base = [[np.float32(r.gauss(i % 3, 0.05)).item() for _ in range(64)] for i in range(40)]
    rows = [(i, v) for i, v in enumerate(base)] + [(3, base[3]), (3, base[3]), (None, base[0]), (50, None), (51, []), (52, base[0][:63]),
            (53, [None] + base[0][1:]), (54, [float("nan")] + base[0][1:]), (55, [float("inf")] + base[0][1:]), (56, [-0.0] * 64)]
    assert rows_of(V.clusters_digest(table_of(spark, rows))) == brute(rows)


def test_fewer_vectors_than_centroids_ties_and_nothing(spark):
    same = [(i, [0.5] * 64) for i in range(5)]
    assert rows_of(V.clusters_digest(table_of(spark, same))) == brute(same)
    assert V.clusters_digest(table_of(spark, [(1, None)])).collect() == []
    assert V.clusters_digest(table_of(spark, [])).collect() == []
    with pytest.raises(Exception, match="too large"):
        V.clusters_digest(table_of(spark, [(1, [1e9] * 64)])).collect()


def test_intervals_hold_every_distance_and_certain_rows_are_right():
    r = np.random.default_rng(3)
    x = np.floor(r.normal(0, 130, (3000, 64))).astype(np.int64)
    for c in (x[:8], x[:2], x[[0, 0, 1]], x[:8] * 1_000_000 // 3):
        m, s = x.mean(0), x.std(0)
        from statistics import NormalDist
        q = [NormalDist().inv_cdf(i / 256) for i in range(1, 256)]
        inner = np.round(m[:, None] + s[:, None] * np.array(q)).astype(np.int64)
        inner = np.clip(inner, x.min(0)[:, None], x.max(0)[:, None] + 1)
        lows = np.concatenate([x.min(0)[:, None], inner], 1)
        highs = np.concatenate([inner - 1, x.max(0)[:, None]], 1)
        cells = np.stack([np.searchsorted(lows[d][1:], x[:, d], side="right") for d in range(64)], 1).astype(np.uint8)
        exact = np.stack([((x - a) ** 2).sum(1) for a in c], 1)
        iv = V.Intervals(c, lows, highs)
        small, large = iv.bounds(cells)
        assert (small <= exact).all() and (exact <= large).all()
        found = iv.nearest(cells)
        sure = found >= 0
        assert (found[sure] == exact.argmin(1)[sure]).all()
        if len(c) == 8:
            assert sure.mean() > 0.5
        assert (V._distances(x, c) == exact).all()


def test_whole_vectors_are_read_only_where_intervals_overlap(spark):
    """Two far groups with one first centroid each: once the centroids have settled no vector is open and no page is read again."""
    r = random.Random(7)
    rows = [(i, [float(np.float32(r.gauss(i % 2, 0.05))) for _ in range(64)]) for i in range(600)]

    def first(seed):
        return sorted(range(600), key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:2]

    seed = next(n for n in range(100) if len({i % 2 for i in first(n)}) == 2)
    _, file, report = V.fit(table_of(spark, rows), k=2, seed=seed, rounds=5)
    assert [(x["open"], x["pages"]) for x in report] == [(600, V.PAGES), (0, 0), (0, 0), (0, 0), (0, 0)]
    plan = V.open_pages(file, [[0] * 64], [[0] * 64], [[0] * 257] * 64, [[0] * 257] * 64)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<cells:binary>" in plan
