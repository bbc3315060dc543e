"""The search over coefficients against a plain one, and its scores against whole evaluations."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cellforge.operators import calibrate, coarse, search

SIGMA = 1.0


def made(spark, seed=8, rows=8, zones=2):
    rng = np.random.default_rng(seed)
    pick = lambda: int(rng.integers(1, 4))
    data = [Row(zone=z, r=100 * z + r, c=c, cr=25 * z + r // 4, cc=c // 4, ha=int(rng.integers(1, 3)), lulc=pick(), seen=pick(), a=float(rng.integers(0, 9)), b=float(rng.integers(1, 9)), keep=float(rng.integers(0, 2))) for z in range(zones) for r in range(rows) for c in range(8)]
    return spark.createDataFrame(data), [d.asDict() for d in data]


START = {k: [("a", "additive", 1.0), ("b", "gaussian_1", 0.0), ("keep", "multiplicative", 0.5 * (k - 1))] for k in (1, 2)}


def projected(cells, coefficients, quotas):
    """The map of one zone, class by class and cell by cell; quotas by coarse cell: {(from or None, class): goal}."""
    taken = {}
    for place, goals in quotas.items():
        for (source, k), goal in goals.items():
            scored = []
            for d in cells:
                if (d["cr"], d["cc"]) == place and d["lulc"] != k and source in (None, d["lulc"]):
                    add, times = 0.0, 1.0
                    for n, kind, beta in coefficients[k]:
                        if kind == "multiplicative":
                            times *= 1 - (1 - beta) * d[n]
                        else:
                            add += beta * d[n]
                    if abs(add * times) >= 1e-14:
                        scored.append((-add * times, d["r"], d["c"], d["ha"]))
            used = 0
            for turn, (_, r, c, ha) in enumerate(sorted(scored)):
                if used >= goal:
                    break
                used += ha if source is None else 1
                taken[r, c] = max(taken.get((r, c), (-1, -1)), (turn, k))
    return {(d["r"], d["c"]): taken[d["r"], d["c"]][1] if (d["r"], d["c"]) in taken else d["lulc"] for d in cells}


def score(cells, coefficients, quotas):
    new = projected(cells, coefficients, quotas)
    r0, n, m = min(d["r"] for d in cells), 1 + max(d["r"] for d in cells) - min(d["r"] for d in cells), 8
    reach = int(4 * SIGMA + 0.5)
    w = [math.exp(-i * i / (2 * SIGMA * SIGMA)) for i in range(-reach, reach + 1)]
    w = [x / sum(w) for x in w]

    def at(i, n):
        i %= 2 * n
        return 2 * n - 1 - i if i >= n else i

    loss = 0.0
    for k in coefficients:
        for test in (lambda d, x, k=k: d["lulc"] != k and x == k, lambda d, x, k=k: d["lulc"] == k and x != k):
            f = np.zeros((n, m))
            for d in cells:
                f[d["r"] - r0, d["c"]] = test(d, new[d["r"], d["c"]]) - test(d, d["seen"])
            f = np.array([[sum(w[i + reach] * f[at(r + i, n), c] for i in range(-reach, reach + 1)) for c in range(m)] for r in range(n)])
            f = np.array([[sum(w[i + reach] * f[r, at(c + i, m)] for i in range(-reach, reach + 1)) for c in range(m)] for r in range(n)])
            loss += np.abs(f).sum()
    return sum(new[d["r"], d["c"]] != d["lulc"] for d in cells) / (loss + 1)


def plain_search(cells, quotas, generations, scales):
    """One try after the other, every one evaluated as a whole."""
    kept = {k: list(rows) for k, rows in START.items()}
    top = score(cells, kept, quotas)
    log = [(0, 0, None, None, None, top)]
    put = lambda c, n, k, v: {x: [(m, kind, v if (m, x) == (n, k) else b) for m, kind, b in rows] for x, rows in c.items()}
    for g in range(generations):
        start = {(n, k): b for k, rows in kept.items() for n, _, b in rows}
        tries = [(n, k, start[n, k] + d) for n in ("a", "b") for k in START for d in (-1.0, 1.0)]
        alone = [score(cells, put(kept, *t), quotas) for t in tries]
        for i in sorted(range(len(tries)), key=lambda i: (-round(alone[i], 12), i)):
            n, k, v = tries[i]
            if (s := score(cells, put(kept, n, k, v), quotas)) > top * (1 + 1e-12):
                kept, top = put(kept, n, k, v), s
                log.append((g, len(log), n, k, v, s))
                for x in scales:
                    for sign in (-1, 1):
                        if (s := score(cells, put(kept, n, k, v + sign * x), quotas)) > top * (1 + 1e-12):
                            kept, top = put(kept, n, k, v + sign * x), s
                            log[-1] = (g, log[-1][1], n, k, v + sign * x, s)
    return log


@pytest.mark.parametrize("matrix", [False, True])
def test_zones_at_once_equal_a_plain_search_of_each(spark, matrix):
    df, data = made(spark)
    scales = (0.5, 2.0, 10.0)
    quotas = coarse.change_matrix(df, "lulc", "seen", (1, 2, 3)) if matrix else coarse.goals(df, "lulc", "seen", "ha", (1, 2, 3))
    state = search.calibrate_zones(df, START, quotas, "seen", SIGMA, generations=2, scales=scales, together=3, block=5)
    got = {}
    for r in search.best_changes(state).orderBy("zone", "step").collect():
        got.setdefault(r["zone"], []).append((r["generation"], r["step"], r["layer"], r["class_id"], r["beta"], r["score"]))
    for z in (0, 1):
        by = {}
        for q in quotas.collect():
            if q["cr"] // 25 == z:
                key, n = ((q["from_class"], q["to_class"]), q["n"]) if matrix else ((None, q["class_id"]), q["goal"])
                if key[1] in START and key[0] != key[1] and n > 0:
                    by.setdefault((q["cr"], q["cc"]), {})[key] = n
        want = plain_search([d for d in data if d["zone"] == z], by, 2, scales)
        assert [x[:5] for x in got[z]] == [x[:5] for x in want]
        assert all(abs(a[5] - b[5]) < 1e-9 for a, b in zip(got[z], want, strict=True))
    end = {(r["zone"], r["layer"], r["class_id"]): r["beta"] for r in search.best_coefficients(state, START).collect()}
    assert len(end) == 12 and all(end[z, x[2], x[3]] == x[4] for z in got for i, x in enumerate(got[z]) if x[2] and not any(y[2:4] == x[2:4] for y in got[z][i + 1 :]))


def test_scores_of_tries_equal_whole_evaluations(spark):
    df, _ = made(spark, 3, rows=12, zones=1)
    goals = coarse.goals(df, "lulc", "seen", "ha", (1, 2, 3))
    layers = search.Layers.of(START)
    moves = [None, ("a", 1, -1.0), ("a", 2, 5.0), ("b", 1, 2.0), ("b", 2, -3.0)]
    want = {r["try_id"] - 1: (r["changed"], r["loss"]) for r in calibrate.evaluate(df, START, moves, goals, "seen", SIGMA, 12, 8).collect()}
    b, m = layers.rows(START)
    flat = lambda rows: [v for row in rows for v in row]
    tries = [(START_AT[k], layers.adds.index(n), dict((x, v) for x, _, v in START[k])[n] + d) for n, k, d in moves[1:]]
    state = spark.createDataFrame([(0, flat(b), flat(m), [t[0] for t in tries], [t[1] for t in tries], [t[2] for t in tries])], "zone int, b array<double>, m array<double>, try_class array<int>, try_layer array<int>, try_value array<double>")
    cells = search.packed(df.withColumn("zone", F.lit(0)), goals, layers, "seen")
    changed = cells.join(state, "zone").mapInPandas(lambda rows: search.changes(rows, layers), search.CHANGES.replace("{zone}", "int"))
    extents = spark.createDataFrame([(0, 0, 0, 12, 8)], "zone int, r0 int, c0 int, n_rows int, n_cols int")
    got = {r["try"]: (r["changed"], r["loss"]) for r in search.sums(changed, extents, layers, SIGMA, "int", len(tries), 5).collect()}
    for t, (n, loss) in want.items():
        mine = got[-1] if t < 0 else tuple(x + y for x, y in zip(got[-1], got.get(t, (0, 0.0)), strict=True))
        assert mine[0] == n and abs(mine[1] - loss) < 1e-9


START_AT = {k: i for i, k in enumerate(START)}


def test_odd_grids(spark):
    df, _ = made(spark, zones=1, rows=4)
    odd = df.withColumns({"a": F.when(F.col("c") != 3, F.col("a")), "lulc": F.when(F.col("c") != 5, F.col("lulc")), "zone": F.lit("only")})
    goals = coarse.goals(df, "lulc", "seen", "ha", (1, 2, 3)).withColumn("goal", F.when((F.col("cc") == 0) & (F.col("class_id") == 3), float("nan")).otherwise(F.col("goal").cast("double")))
    log = search.best_changes(search.calibrate_zones(odd, START, goals, "seen", SIGMA, scales=()))
    assert log.where("zone = 'only' AND step = 0").count() == 1
    assert search.calibrate_zones(df.where("r < 0"), START, goals, "seen", SIGMA).count() == 0
    still = search.calibrate_zones(df, START, goals.where("goal > 1000000"), "seen", SIGMA, scales=())
    assert search.best_changes(still).count() == 1  # nothing to allocate, nothing to keep


@pytest.mark.parametrize("by", [[], ["k"]])
def test_sparse_distances_equal_brute_force(spark, by):
    from cellforge.operators import kernels

    rng = np.random.default_rng(4)
    sites = [(int(k), int(r), int(c)) for k, r, c in zip(rng.integers(0, 3, 60), rng.integers(-40, 150, 60), rng.integers(0, 90, 60), strict=True) if k < 2]
    targets = [(int(k), int(r), int(c)) for k, r, c in zip(rng.integers(0, 3, 200), rng.integers(-90, 300, 200), rng.integers(-20, 130, 200), strict=True)] + sites[:9] * 2
    one, two = (spark.createDataFrame(x, "k int, r int, c int") for x in (sites, targets))
    got = {tuple(r)[:-1]: r["d2"] for r in kernels.nearest_sq(one, two, by).select(*by, "r", "c", "d2").collect()}
    want = {}
    for k, r, c in targets:
        near = [(r - i) ** 2 + (c - j) ** 2 for q, i, j in sites if not by or q == k]
        want[(k, r, c) if by else (r, c)] = float(min(near)) if near else None
    assert got == want
    assert kernels.nearest_sq(one, two.where("r > 900"), by).count() == 0


def test_distances_of_tall_grids_make_no_frame_anew(spark):
    from cellforge.operators import kernels

    sites = spark.range(40).selectExpr("CAST(id * id * 7 AS int) AS r", "CAST(id % 3 AS int) AS c")
    d = kernels.nearest_sq(sites, spark.range(12000).selectExpr("CAST(id AS int) AS r", "1 AS c"))
    plan = d._jdf.queryExecution().analyzed().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    at = [(k * k * 7, k % 3) for k in range(40)]
    assert {r["r"]: r["d2"] for r in d.collect()} == {r: float(min((r - i) ** 2 + (1 - c) ** 2 for i, c in at)) for r in range(12000)}


def test_a_block_of_many_tries_is_read_once(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(8)
    blur = search.Blur(256, search.blur_weights(SIGMA), search.Layers.of(START))
    rows = pd.concat([pd.DataFrame({"try": t, "r": at // 30, "c": at % 30, "was": rng.integers(1, 5, 60), "old": rng.integers(1, 5, 60), "new": rng.integers(1, 5, 60)}) for t in range(-1, 25) for at in [rng.permutation(600)[:60]]], ignore_index=True)
    alone = {t: blur.losses(rows[rows["try"].isin([-1, t])], 0, 0, 20, 30)[t] for t in range(-1, 25)}
    read, get = [], pd.DataFrame.__getitem__
    monkeypatch.setattr(pd.DataFrame, "__getitem__", lambda self, key: read.append(key) or get(self, key))
    assert blur.losses(rows.sample(frac=1, random_state=1), 0, 0, 20, 30) == pytest.approx(alone)
    assert len(read) < 25


def test_many_coarse_cells_are_ranked_in_few_arrays(spark, monkeypatch):
    """Tries of many coarse cells at once, whatever is held at a time, and no array as large as all of them together."""
    df, _ = made(spark)
    layers = search.Layers.of(START)
    b, m = layers.rows(START)
    s = search.Search(layers).first(0, [v for row in b for v in row], [v for row in m for v in row])
    for quotas in (coarse.change_matrix(df, "lulc", "seen", (1, 2, 3)), coarse.goals(df, "lulc", "seen", "ha", (1, 2, 3))):
        rows = search.packed(df, quotas, layers, "seen").toPandas()
        for n in ("b", "m", "try_class", "try_layer", "try_value"):
            rows[n] = [np.array(s[n])] * len(rows)
        whole = list(search.changes(iter([rows]), layers))
        monkeypatch.setattr(search, "HELD", 1000)
        parts = list(search.changes(iter([rows]), layers))
        monkeypatch.undo()
        order = ["zone", "try", "r", "c"]
        one, two = (search.pd.concat(x).sort_values(order, ignore_index=True) for x in (whole, parts))
        assert one.equals(two) and len(whole) == 1 and len(parts) > 1 and (one["try"] >= 0).any()


def test_row_pass_takes_far_sites_in_whole_rows(monkeypatch):
    """Rows of few, far sites: by steps over all rows that are not settled, and by parabolas beyond them, both as brute force."""
    from cellforge.operators import kernels

    rng = np.random.default_rng(8)
    g = np.where(rng.random((40, 300)) < 0.01, rng.integers(0, 90, (40, 300)), np.inf)
    g[3] = np.inf
    x = np.arange(300)
    want = np.array([((x[:, None] - x[None]) ** 2 + (row * row)[None]).min(axis=1) for row in g])
    assert (kernels._row_pass(g) == want).all()
    monkeypatch.setattr(kernels, "STEPS", 20)
    assert (kernels._row_pass(g) == want).all()
    slow = []
    monkeypatch.setattr(kernels.np, "searchsorted", lambda *a, **k: slow.append(1))
    monkeypatch.setattr(kernels, "STEPS", 1024)
    kernels._row_pass(g)
    assert not slow and kernels.STEPS * kernels.STEPS > 90 * 90
