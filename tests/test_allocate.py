"""Window-form allocation against a literal round robin, and edge grids."""

import numpy as np
import pytest
from pyspark.sql import Row

from cellforge.operators import allocate, coarse, grid, kernels, remap, vector


def round_robin(s, ha, lulc, goals):
    """One coarse cell: s[class][cell], cells in order of place."""
    out, order, pos, left = list(lulc), {}, {}, dict(goals)
    if any(np.isnan(g) for g in goals.values()):
        return out
    for k in goals:
        ok = [i for i in range(len(lulc)) if lulc[i] != k and abs(s[k][i]) >= 1e-14]
        order[k], pos[k] = sorted(ok, key=lambda i: (-s[k][i], i)), 0
    for _ in range(len(lulc)):
        for k in sorted(goals):
            if left[k] > 0 and pos[k] < len(order[k]):
                i = order[k][pos[k]]
                out[i], pos[k], left[k] = k, pos[k] + 1, left[k] - ha[i]
    return out


@pytest.mark.parametrize("nan", [False, True])
def test_against_round_robin(spark, nan):
    rng = np.random.default_rng(4 + nan)
    rows, goals, want = [], [], {}
    for b in range(12):
        n = 25
        x = {k: rng.integers(-1, 5, n) / 4.0 for k in (1, 2, 3)}
        ha, lulc = rng.integers(1, 4, n), rng.integers(1, 5, n)
        g = {k: float(rng.choice([-3, 0, 2, 7, 60])) for k in (1, 2, 3)}
        if nan and b % 3 == 0:
            g[2] = float("nan")
        got = round_robin(x, ha, lulc, g)
        for i in range(n):
            rows.append(Row(r=b, c=i, cr=b, cc=0, ha=int(ha[i]), lulc=int(lulc[i]), a=float(x[1][i]), b=float(x[2][i]), d=float(x[3][i])))
            want[b, i] = int(got[i])
        goals += [Row(cr=b, cc=0, class_id=k, goal=v) for k, v in g.items()]
    coef = {1: [("a", "additive", 1.0)], 2: [("b", "additive", 1.0)], 3: [("d", "additive", 1.0)]}
    made = allocate.allocate_gridded(spark.createDataFrame(rows), coef, spark.createDataFrame(goals)).collect()
    assert {(r["r"], r["c"]): r["lulc"] for r in made} == want


def cells(spark, lulc, **more):
    return spark.createDataFrame([Row(r=i // 3, c=i % 3, cr=0, cc=0, ha=1, lulc=v, x=float(i), **more) for i, v in enumerate(lulc)])


def test_exclusive_keeps_expanding_classes(spark):
    x = cells(spark, [1, 1, 1, 2, 2, 2, 3, 3, 3])
    goals = spark.createDataFrame([(0, 0, 1, 2.0), (0, 0, 2, 9.0)], "cr int, cc int, class_id int, goal double")
    out = {(r["r"], r["c"]): r["lulc"] for r in allocate.allocate_exclusive(x, {1: [("x", "additive", 1.0)], 2: [("x", "additive", 1.0)]}, goals).collect()}
    assert [out[i // 3, i % 3] for i in range(6)] == [1, 1, 1, 2, 2, 2]


def test_no_layer_or_null_layer_is_never_taken(spark):
    x = cells(spark, [1] * 9)
    goals = spark.createDataFrame([(0, 0, 2, 9.0)], "cr int, cc int, class_id int, goal double")
    assert {r["lulc"] for r in allocate.allocate_gridded(x, {2: []}, goals).collect()} == {1}
    y = x.selectExpr("r", "c", "cr", "cc", "ha", "lulc", "IF(c = 0, NULL, x) AS x")
    out = allocate.allocate_gridded(y, {2: [("x", "additive", 1.0)]}, goals).collect()
    assert all((r["lulc"] == 1) == (r["c"] == 0) for r in out)


def test_matrix_quota_and_properties(spark):
    x = cells(spark, [1, 1, 1, 1, 2, 2, 3, 3, 3])
    m = spark.createDataFrame([(0, 0, 1, 2, 2), (0, 0, 3, 1, 1)], "cr int, cc int, from_class int, to_class int, n long")
    c = {1: [("x", "additive", 1.0)], 2: [("x", "additive", 1.0)]}
    out = {(r["r"], r["c"]): r["lulc"] for r in allocate.allocate_from_matrix(x, c, m).collect()}
    assert [out[i // 3, i % 3] for i in range(9)] == [1, 1, 2, 2, 2, 2, 3, 3, 1]
    net = coarse.net_change(m).agg({"n": "sum"}).first()[0]
    assert net == 0


def test_impulse_gives_the_kernel(spark):
    x = spark.createDataFrame([Row(r=r, c=c, v=float((r, c) == (10, 10))) for r in range(21) for c in range(21)])
    k = kernels.kernel_array(1.0)
    got = {(r["r"], r["c"]): r["value"] for r in kernels.convolve(x, "v", k, 9).collect()}
    assert all(abs(got[10 + i - 9, 10 + j - 9] - k[i, j]) < 1e-12 for i in range(18) for j in range(18))


def test_distances_by_brute_force(spark):
    rng = np.random.default_rng(1)
    site = rng.random((12, 15)) < 0.05
    x = spark.createDataFrame([Row(r=r, c=c, s=bool(site[r, c])) for r in range(12) for c in range(15)])
    at = np.argwhere(site)
    for q in kernels.distance_transform_sq(x, "s").collect():
        assert q["d2"] == ((at - [q["r"], q["c"]]) ** 2).sum(1).min()
    none = kernels.distance_transform_sq(x.selectExpr("r", "c", "false AS s"), "s").collect()
    assert all(q["d2"] is None for q in none)


def test_distances_far_beyond_the_first_steps(spark):
    sites = {(3, 5), (40, 390)}
    x = spark.createDataFrame([Row(r=r, c=c, s=(r, c) in sites) for r in range(45) for c in range(400)])
    for q in kernels.distance_transform_sq(x, "s").collect():
        assert q["d2"] == min((q["r"] - a) ** 2 + (q["c"] - b) ** 2 for a, b in sites)


def test_class_convolutions_by_brute_force(spark):
    rng = np.random.default_rng(6)
    k = rng.integers(1, 4, (9, 14))
    x = spark.createDataFrame([Row(r=r, c=c, class_id=int(k[r, c])) for r in range(9) for c in range(14)])
    halves = (1, 3, 30)
    table = {h: kernels.kernel_array(h) for h in halves}
    got = {(q["half_life"], q["class_id"], q["r"], q["c"]): q["value"] for q in kernels.class_convolutions(x, [1, 2, 9], halves, block=4).collect()}
    assert len(got) == 3 * 3 * 9 * 14
    for (h, cls, r, c), v in got.items():
        reach = len(table[h]) // 2
        want = sum(table[h][r - i + reach, c - j + reach] for i in range(9) for j in range(14) if k[i, j] == cls and -reach <= r - i < reach and -reach <= c - j < reach)
        assert abs(v - want) < 1e-9


def test_convolution_fields_are_as_large_as_their_cells(spark, monkeypatch):
    """A long, narrow grid is transformed in long, narrow fields; blocks with cells of the halo alone have no rows."""
    sizes = []
    transform = np.fft.rfft2
    monkeypatch.setattr(np.fft, "rfft2", lambda x, *size: sizes.append((size[0] if size else x.shape)) or transform(x, *size))
    k = np.random.default_rng(7).integers(1, 4, (700, 3))
    rows = kernels.pd.DataFrame({"r": np.repeat(np.arange(700), 3), "c": np.tile(np.arange(3), 700), "class_id": k.ravel()})
    df = spark.createDataFrame(rows)
    made = []

    class Caught(Exception):
        pass

    def caught(self, run, schema):
        made.append(run)
        raise Caught

    monkeypatch.setattr(type(df.groupBy("r")), "applyInPandas", caught)
    with pytest.raises(Caught):
        kernels.class_convolutions(df, [1, 2], (2, 30))
    rows["__k"] = rows["class_id"]
    got = made[0]((0, 0), rows)
    assert len(got) == 2 * 2100 and all(b <= 32 for _, b in sizes)
    assert not len(made[0]((0, 1), rows))
    one = got[(got["class_id"] == 2) & (got["r"] == 350) & (got["c"] == 1)]["found"].iloc[0]
    for h, v in zip((2, 30), one, strict=True):
        w = kernels.kernel_array(h)
        n = len(w) // 2
        want = sum(w[350 - i + n, 1 - j + n] for i in range(700) for j in range(3) if k[i, j] == 2 and -n <= 350 - i < n)
        assert abs(v - want) < 1e-8


def test_reclassify_and_restore(spark):
    from pyspark.sql import functions as F

    from cellforge.config import RECLASS, RESTORE

    x = spark.createDataFrame([(0, 0, 10), (0, 1, None), (0, 2, 999)], "r int, c int, code int")
    assert [r["k"] for r in remap.reclassify(x, RECLASS, "code", "k").orderBy("c").collect()] == [2, None, None]
    assert all(RECLASS[v] == k for k, v in RESTORE.items())
    y = x.select(remap.restore_detailed(F.col("code"), RESTORE).alias("v")).collect()
    assert [r["v"] for r in y] == [10, None, 999]


def test_polygon_with_a_hole_free_concave_ring(spark):
    x = spark.createDataFrame([Row(r=r, c=c) for r in range(6) for c in range(6)])
    ring = spark.createDataFrame([(1, [0.0, 6.0, 6.0, 3.0, 0.0], [0.0, 0.0, 6.0, 2.0, 6.0])], "id int, x array<double>, y array<double>")
    got = {(r["r"], r["c"]) for r in vector.rasterize(x, ring, block=2).collect()}
    assert (0, 2) in got and (5, 2) not in got and (4, 0) in got and (4, 5) in got


def test_touched_cells_by_points_along_the_ring(spark):
    """Cells that hold points of a closely sampled ring, or whose centre is inside."""
    x, y = [2.3, 17.8, 9.1, 12.4, 4.7], [1.2, 6.9, 7.3, 18.6, 12.1]
    grid_cells = spark.createDataFrame([Row(r=r, c=c) for r in range(20) for c in range(20)])
    ring = spark.createDataFrame([(1, x, y)], "id int, x array<double>, y array<double>")
    got = {(q["r"], q["c"]) for q in vector.rasterize(grid_cells, ring, block=8, all_touched=True).collect()}
    centres = {(q["r"], q["c"]) for q in vector.rasterize(grid_cells, ring, block=8).collect()}
    t = np.linspace(0, 1, 20001)[:, None]
    p, q = np.c_[x, y], np.roll(np.c_[x, y], -1, axis=0)
    along = np.floor(np.concatenate([a + t * (b - a) for a, b in zip(p, q, strict=True)])).astype(int)
    assert got == centres | {(int(b), int(a)) for a, b in along}


def test_windows_and_stitching(spark):
    x = cells(spark, [1] * 9)
    assert grid.window(x, 1, 1, 5, 5).count() == 4
    top = x.where("c = 0").selectExpr("r", "c", "9 AS lulc")
    assert grid.overlay(x.select("r", "c", "lulc"), top, "lulc").where("lulc = 9").count() == 3
    both = top.selectExpr("*", "1 AS k").unionByName(top.selectExpr("r", "c", "8 AS lulc", "2 AS k"))
    assert {r["lulc"] for r in grid.overlay_ordered(both, "lulc", "k").collect()} == {8}


def test_blocks_by_extent(spark):
    from cellforge.plans import zones

    one = lambda *v: spark.createDataFrame([v], "r0 int, c0 int, r1 int, c1 int")
    whole, own = spark.createDataFrame([("all",)], "b string"), spark.createDataFrame([("own",)], "b string")
    assert zones.blocks_for(one(0, 0, 9, 9), one(0, 0, 9, 9), whole, own).first()["b"] == "all"
    assert zones.blocks_for(one(0, 0, 9, 8), one(0, 0, 9, 9), whole, own).first()["b"] == "own"


def test_small_kernels(spark):
    k = kernels.gaussian_kernel_cdf(spark, 5, 2.0).collect()
    assert len(k) == 25 and abs(sum(r["w"] for r in k) - 1) < 1e-12
    w = {(r["i"], r["j"]): r["w"] for r in k}
    assert w[2, 2] == max(w.values()) and abs(w[0, 1] - w[1, 0]) < 1e-15
    s = {(r["half_life"], r["dr"], r["dc"]): r["w"] for r in kernels.kernel_set(spark, [1, 2]).collect()}
    assert len(s) == 18**2 + 36**2 and abs(s[2.0, 0, 2] - 0.5) < 1e-12 and (1.0, 9, 0) not in s


def test_loss_is_zero_only_for_equal_maps(spark):
    from cellforge.operators import fit

    rows = [Row(r=r, c=c, baseline=1 + (r + c) % 3, projected=1 + (r * c) % 3, observed=1 + (r * c) % 3) for r in range(14) for c in range(14)]
    same = spark.createDataFrame(rows)
    assert fit.fit_loss(same, (1, 2, 3), 1.0, 14, 14).count() == 0
    other = same.selectExpr("r", "c", "baseline", "baseline AS projected", "observed")
    assert all(r["loss"] > 0 for r in fit.fit_loss(other, (1, 2, 3), 1.0, 14, 14).collect())
    assert fit.weighted_score(same, fit.fit_loss(same, (1, 2, 3), 1.0, 14, 14)).first()["loss"] == 0


def test_change_matrix_properties(spark):
    x = spark.createDataFrame([Row(cr=0, cc=0, a=1 + i % 4, b=1 + (i * i) % 4) for i in range(40)])
    m = coarse.change_matrix(x, "a", "b", (1, 2, 3, 4))
    rows = {r["from_class"]: r["n"] for r in m.groupBy("from_class").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert rows == {r["a"]: r["count"] for r in x.groupBy("a").count().collect()}
    assert coarse.dense_change_matrix(m, (1, 2, 3, 4)).count() == 16
    back = coarse.from_mosaic(coarse.mosaic(m, 4), 4)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, m.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layers_of_a_cell_move_once_as_sums(spark):
    layers = spark.range(50).selectExpr("int(id) AS r", "int(id % 7) AS c", "double(id) AS a", "double(1) AS b").unpivot(["r", "c"], ["a", "b"], "layer_id", "x")
    table = spark.createDataFrame([("a", 1, allocate.ADDITIVE, 2.0), ("b", 1, allocate.MULTIPLICATIVE, 0.5)], "layer_id string, class_id int, kind string, beta double")
    s = allocate.suitability_long(layers, table)
    assert "SortMergeJoin" not in plan_of(s) and {(r["r"], r["s"]) for r in s.collect()} == {(i, float(i)) for i in range(50)}


def test_no_class_goes_to_one_task(spark):
    scored = spark.range(400).selectExpr("int(id) AS r", "0 AS c", "int(id % 2) AS class_id", "double(id) AS s", "1 AS ha")
    goals = spark.createDataFrame([(0, 3.0), (1, -1.0)], "class_id int, goal double")
    plans = []
    real = allocate.stored
    allocate.stored = lambda df: plans.append(plan_of(df)) or real(df)
    try:
        taken = {r["r"] for r in allocate.claims_by_range(scored, goals).collect()}
    finally:
        allocate.stored = real
    assert taken == {398, 396, 394} and "hashpartitioning(class_id" not in plans[0] and "BroadcastHashJoin" in plans[0]
