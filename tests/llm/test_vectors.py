"""Collision search and hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.llm import collision_search as cs
from cellforge.llm.common import table
from cellforge.llm.vector_blocks import prefix
from oracle import SMALL

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, is_query, k):
    """{(row of the query): [(id, score)]} over usable rows, each its own."""
    good = [(i, v) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dims = max((len(v) for _, v in good), default=0)
    good = [(i, [*v, *[0.0] * (dims - len(v))]) for i, v in good]
    out = []
    for a, (i, q) in enumerate(good):
        if is_query(i):
            scores = []
            for b, (j, v) in enumerate(good):
                if a != b:
                    s = 0.0
                    for x, y in zip(q, v, strict=True):
                        s += x * y
                    scores.append((-s, j))
            out.append((i, [(j, -s) for s, j in sorted(scores)[:k]]))
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


@pytest.mark.parametrize("block", [cs.CANDIDATE_BLOCK, 100])
def test_recall_and_exact_scores(spark, block):
    x = table(spark, SMALL, "embeddings")
    want = dict(brute([tuple(r) for r in x.select("vec_id", "embedding").collect()], lambda i: i % 20 == 0, 20))
    got = found(cs.nearest(cs.usable(x), F.col("vec_id") % 20 == 0, block=block))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert all(v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert hits >= 0.93 * 20 * len(want)
    assert all(s == dict(brute_scores)[j] for q, v in got.items() for brute_scores in [scores_of(x, q)] for j, s in v)


CACHE = {}


def scores_of(x, q):
    if not CACHE:
        CACHE.update({i: v for i, v in x.select("vec_id", "embedding").collect()})
    return [(j, float(cs.inner(np.array(CACHE[q], float), np.array([v], float).T)[0])) for j, v in CACHE.items()]


def test_recall_on_lengths_clusters_and_many_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 24))
    x *= rng.lognormal(0, 0.7, 6000)[:, None]  # lengths differ widely
    x[4000:] = x[0] + 1e-3 * rng.normal(size=(2000, 24))  # a third of all rows are near copies
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = found(cs.nearest(cs.usable(df), F.col("vec_id") % 60 == 0, block=1000))
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    hits = [len(set(j for j, _ in got[q]) & set(np.argsort(-s[q])[:20].tolist())) / 20 for q in range(0, 6000, 60)]
    assert np.mean(hits) >= 0.9 and len(got) == 100


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0], 1), (20, [0.5, -1.0, 3.0], 1), (20, [0.5, -1.0, 3.0], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 1), (6, [inf], 1), (7, [0.0, 0.0], 1), (8, [], 1), (None, [1.0], 1), (9, [-1.0], None), (10, [1.0, 2.0], 3), (40, [1e300, 1e300], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("x")).withColumn("block", F.lit(1)).withColumn("norm", F.lit(None).cast("int"))
    for block in (1000, 2):
        got = [tuple(r) for r in cs.nearest(cs.usable(df), F.col("vec_id") % 20 == 0, block=block).collect()]
        want = [(i, n + 1, j, s) for i, v in brute(rows, lambda i: i % 20 == 0, 20) for n, (j, s) in enumerate(v)]
        assert sorted(got) == sorted(want)  # few rows: every one is found, repeated ids each for itself
    assert cs.op12_collision_search(spark.createDataFrame([], VECTORS)).count() == 0


def test_threshold_keeps_its_promise():
    rng = np.random.default_rng(0)
    n = cs.threshold(64, 1.0, 0.9)
    hits = (np.abs(rng.standard_normal((4000, 64))) <= 1.0).sum(1)
    assert np.mean(hits >= n) >= 0.88 and np.mean(hits >= n + 3) < 0.9


def test_prefix_search(spark):
    df = spark.range(0, 12).select("id", F.expr("transform(sequence(9, 0), i -> cast(i as double))").alias("tops"))
    got = {r["id"]: r["n"] for r in df.select("id", prefix(F.col("tops"), lambda t: t >= F.col("id")).alias("n")).collect()}
    assert got == {i: max(0, 10 - i) for i in range(12)}


def mined(rows, is_anchor, scale=256, positives=5, negatives=10):
    """The contract of op13 in plain loops."""
    good = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(scale * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, q, k) in enumerate(good):
        if is_anchor(i):
            scored = sorted((-sum(x * y for x, y in zip(q, v)), j, other != k) for b, (j, v, other) in enumerate(good) if a != b)
            for s, p, _ in [x for x in scored if not x[2]][:positives]:
                for n, (t, j, _) in enumerate([x for x in scored if x[2] and -30 * s <= -100 * x[0] <= -90 * s][:negatives]):
                    out.append((i, p, n + 1, j, -s, -t))
    return sorted(out)


@pytest.mark.parametrize("block", [8192, 7])
def test_hard_negatives_equal_brute_force(spark, block):
    from cellforge.llm import hard_negatives as hn
    from cellforge.llm.topk import quantised

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] * (0.2 + i % 4) + 0.2 * rng.normal(size=12)).tolist(), int(i % 6 if i % 5 else rng.integers(0, 6))) for i in range(240)]
    rows += [(300 + i, rows[0][1], 0) for i in range(60)]  # a fifth of all rows are copies
    rows += [(100, rows[3][1], 3), (100, rows[3][1], None), (None, rows[1][1], 1), (501, None, 1), (502, [1.0, None], 1), (503, [float("nan")], 1), (600, [0.0] * 12, 2), (700, [], 1), (900, [5.0, -2.0, 1.0], 4), (901, [4.0], 4), (902, [3e9, 1e9], 9)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("x")).withColumn("angles", F.lit(1)).withColumn("low", F.lit(None).cast("int"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    x = quantised(df, scale=256, more=[label.alias("label")])
    got = sorted(tuple(r) for r in hn.mine(x, F.col("vec_id") % 20 == 0, block=block).collect())
    assert got == mined(rows, lambda i: i % 20 == 0) and len(got) > 300
    if block > 1000:
        assert sorted(tuple(r) for r in hn.op13_hard_negatives(df).collect()) == mined(rows, lambda i: i % 100 == 0)
        assert hn.op13_hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0
        assert hn.op13_hard_negatives(df.where("vec_id % 100 > 0")).count() == 0


def test_bounds_hold_and_prune():
    from cellforge.llm import hard_negatives as hn

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    x = np.concatenate([np.floor(256 * (centres[rng.integers(0, 8, 2000)] + 0.1 * rng.normal(size=(2000, 16)))), np.floor(256 * centres), -np.floor(256 * centres), np.zeros((1, 16))])
    norms = np.sqrt((x * x).sum(1))
    refs = centres / np.sqrt((centres**2).sum(1))[:, None]
    angles = np.arccos(np.clip(refs @ x.T / np.maximum(norms, 1e-300), -1, 1))
    for i in range(0, len(x), 50):
        least, most = hn.bounds(angles[:, i], norms[i], angles, norms)
        s = x @ x[i]
        assert (least <= s).all() and (s <= most).all()
        assert (most < 0.8 * norms[i] ** 2).mean() > 0.5  # most rows are far below
