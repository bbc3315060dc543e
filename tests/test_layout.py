"""Files along a curve, pyramids, commits of zones and maps of many scenarios, against plain forms of them."""

import glob
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cellforge.operators import allocate, coarse, grid, pyramid
from cellforge.plans import pipeline
from cellforge.sources import grids


def test_a_window_reads_few_row_groups(spark, tmp_path):
    n = 512
    x = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("r"), (F.col("id") % n).cast("int").alias("c"), F.xxhash64("id").alias("key"), F.rand(1).alias("v")).repartition(8)
    path = str(tmp_path / "z")
    grids.write_clustered(x, path, files=8, group_bytes=64 << 10)
    files = glob.glob(f"{path}/*.parquet")
    assert len(files) <= 9  # not tasks times files
    r0, c0, side = 100, 300, n // 10  # 1 % of the map
    hit = total = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            rs, cs = (meta.row_group(g).column(at[k]).statistics for k in ("r", "c"))
            total += 1
            hit += rs.max >= r0 and rs.min < r0 + side and cs.max >= c0 and cs.min < c0 + side
    assert total >= 20 and hit <= max(4, 0.2 * total)
    got = grid.window(spark.read.parquet(path), r0, c0, side, side)
    assert got.count() == side * side and got.exceptAll(x).count() == 0
    assert spark.read.parquet(path).columns == x.columns
    grids.write_clustered(x.withColumn("zone", F.col("r") % 2), str(tmp_path / "by"), files=4, by=("zone",))
    assert len(glob.glob(f"{tmp_path}/by/*/*.parquet")) <= 7


def test_pyramid_equals_overviews_of_the_fine_map(spark):
    rng = np.random.default_rng(1)
    data = [Row(r=r, c=c, k=None if rng.random() < 0.1 else int(rng.integers(1, 4))) for r in range(37) for c in range(50) if rng.random() < 0.8]
    x = spark.createDataFrame(data, "r int, c int, k int")
    got = pyramid.pyramid(x, "k", 6)
    for level in range(1, 7):
        want = {tuple(r) for r in grid.overview(x.where("k IS NOT NULL"), 2**level, "k").select("r", "c", "k").collect()}
        own = got.where(F.col("level") == level).collect()
        assert {(r["r"], r["c"], r["k"]) for r in own} == want
    keys = {(r["level"], r["key"]) for r in got.collect()}
    assert all((level + 1, key // 4) in keys for level, key in keys if level < 6)
    sums = {r["level"]: r["n"] for r in pyramid.histograms(x, "k", 6).groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert set(sums.values()) == {sum(d.k is not None for d in data)}
    assert pyramid.pyramid(x.where("r < 0"), "k", 3).count() == 0


def test_morton_keys(spark):
    rows = [(0, 0), (1, 0), (0, 1), (5, 9), (2**20, 3), (2**31 - 1, 2**31 - 1)]
    got = {(r["r"], r["c"]): r["k"] for r in spark.createDataFrame(rows, "r int, c int").withColumn("k", pyramid.morton()).collect()}
    for r, c in rows:
        assert got[r, c] == sum(((r >> i) & 1) << (2 * i + 1) | ((c >> i) & 1) << (2 * i) for i in range(31))


@pytest.mark.parametrize("together", [None, 2])
def test_killed_run_goes_on_without_repeated_or_lost_zones(spark, tmp_path, together):
    path = str(tmp_path / "out")
    x = spark.range(1000).select((F.col("id") % 7).cast("int").alias("zone"), F.col("id").alias("v"))
    broken = x.withColumn("v", F.when((F.col("zone") == 5) & (F.col("v") > 900), F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="killed"):
        grids.commit_zones(broken, path, ["zone"], together)
    first = grids.committed(spark, path, ["zone"])
    done = set() if first is None else {r["zone"] for r in first.collect()}
    assert 5 not in done
    assert grids.commit_zones(x, path, ["zone"], together) == 7 - len(done)
    got = spark.read.parquet(f"{path}/cells")
    assert sorted((r["zone"], r["v"]) for r in got.collect()) == sorted((i % 7, i) for i in range(1000))
    manifest = grids.committed(spark, path, ["zone"]).collect()
    assert sorted((r["zone"], r["n"]) for r in manifest) == [(z, len(range(z, 1000, 7))) for z in range(7)]
    # Left without an entry by a killed run: replaced as a whole.
    extra = x.where("zone = 3").withColumn("zone", F.lit(9))
    extra.limit(5).write.mode("append").partitionBy("zone").parquet(f"{path}/cells")
    assert grids.commit_zones(x.unionByName(extra), path, ["zone"], together) == 1
    assert spark.read.parquet(f"{path}/cells").where("zone = 9").count() == extra.count()
    assert grids.commit_zones(x, path, ["zone"], together) == 0


def made(spark, seed=2):
    rng = np.random.default_rng(seed)
    data = [Row(r=r, c=c, cr=r // 5, cc=c // 5, zone=r // 10, ha=int(rng.integers(1, 4)), lulc=int(rng.integers(1, 4)), seen=int(rng.integers(1, 4)), a=float(rng.integers(0, 9)), b=float(rng.integers(1, 9)) if rng.random() < 0.95 else None, m=float(rng.integers(0, 2))) for r in range(20) for c in range(15)]
    return spark.createDataFrame(data)


LAYERS = {"a": allocate.ADDITIVE, "b": "gaussian_1", "m": allocate.MULTIPLICATIVE}


def test_product_of_scenarios_equals_separate_runs(spark):
    x = made(spark)
    rng = np.random.default_rng(3)
    beta = {(z, s, y, n, k): float(rng.integers(-2, 5)) if n != "m" else float(rng.integers(0, 3)) / 2 for z in (0, 1) for s in ("p", "q") for y in (2030, 2050) for n in LAYERS for k in (1, 2, 3)}
    del beta[0, "p", 2030, "a", 2]  # lacking: 0
    table = spark.createDataFrame([(*key, v) for key, v in beta.items()], "zone int, scenario string, year int, layer string, class_id int, beta double")
    plans = spark.createDataFrame([("p", 2030, 1.0), ("p", 2050, 2.0), ("q", 2030, 0.5)], "scenario string, year int, times double")  # q, 2050 has no goals
    goals = coarse.goals(x, "lulc", "seen", "ha", (1, 2, 3)).crossJoin(plans).withColumn("goal", F.col("goal") * F.col("times")).drop("times")
    got = allocate.allocate_keyed(x, table, goals, ["scenario", "year"], ["zone"], LAYERS)
    rows = {}
    for r in got.collect():
        rows.setdefault((r["scenario"], r["year"]), {})[r["r"], r["c"]] = r["lulc"]
    start = {(r["r"], r["c"]): r["lulc"] for r in x.collect()}
    assert rows["q", 2050] == start and len(rows) == 4 and any(v != start for v in rows.values())
    for s, y in (("p", 2030), ("p", 2050), ("q", 2030)):
        want = {}
        for z in (0, 1):
            own = {k: [(n, LAYERS[n], beta.get((z, s, y, n, k), 0.0)) for n in LAYERS] for k in (1, 2, 3)}
            part = allocate.allocate_gridded(x.where(F.col("zone") == z), own, goals.where((F.col("scenario") == s) & (F.col("year") == y)).drop("scenario", "year"))
            want |= {(r["r"], r["c"]): r["lulc"] for r in part.collect()}
        assert rows[s, y] == want


def test_keyed_cells_are_dealt_by_size_and_scored_once(spark, monkeypatch):
    """As many tasks as rows call for, sums that no filter writes out again, and the same maps by either way of adding up, with a NaN goal, and with keys that cells hold."""
    monkeypatch.setattr(allocate, "TASK_ROWS", 50)
    x = made(spark)
    table = spark.createDataFrame([(z, s, n, k, 1.0 + z + k * (s == "p")) for z in (0, 1) for s in ("p", "q", "r") for n in LAYERS for k in (1, 2, 3)], "zone int, scenario string, layer string, class_id int, beta double")
    net = coarse.goals(x, "lulc", "seen", "ha", (1, 2, 3))
    goals = net.crossJoin(spark.createDataFrame([("p",), ("q",), ("r",)], "scenario string"))
    goals = goals.withColumn("goal", F.when((F.col("scenario") == "q") & (F.col("cr") == 1) & (F.col("class_id") == 2), float("nan")).otherwise(F.col("goal").cast("double")))
    rows = lambda df: {(r["scenario"], r["r"], r["c"]): r["lulc"] for r in df.collect()}
    made_by = lambda: allocate.allocate_keyed(x, table, goals, ["scenario"], ["zone"], LAYERS)
    got = made_by()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 18), REPARTITION_BY_NUM") == 4   # 300 cells of 3 keys
    assert len(re.findall(r"__b#\d+\[0\] = 0", plan)) == 1 and "zip_with" not in plan
    first, start = rows(got), {(r["r"], r["c"]): r["lulc"] for r in x.collect()}
    assert len(first) == 900 and all(v == start[r, c] for (s, r, c), v in first.items() if s == "q" and r // 5 == 1) and any(v != start[r, c] for (s, r, c), v in first.items() if s == "q")
    for z in (0, 1):
        own = {k: [(n, LAYERS[n], 1.0 + z + k) for n in LAYERS] for k in (1, 2, 3)}
        part = allocate.allocate_gridded(x.where(F.col("zone") == z), own, goals.where("scenario = 'p'").drop("scenario"))
        assert all(first["p", r["r"], r["c"]] == r["lulc"] for r in part.collect())
    monkeypatch.setattr(allocate, "WRITTEN_OUT", 0)
    assert rows(made_by()) == first
    held = x.crossJoin(spark.createDataFrame([("p",), ("q",), ("r",)], "scenario string"))
    assert rows(allocate.allocate_keyed(held, table, goals, ["scenario"], ["zone", "scenario"], LAYERS)) == first


def test_diagnostics_are_dealt_by_size(spark, monkeypatch):
    """Tasks by the number of cells and classes, none of which sorts every class's cells twice, and the outputs of the plain steps."""
    monkeypatch.setattr(allocate, "TASK_ROWS", 50)
    x = made(spark)
    own = {k: [("a", allocate.ADDITIVE, 1.0 + k), ("m", allocate.MULTIPLICATIVE, 0.5), ("none", allocate.ADDITIVE, 0.0)] for k in (1, 2, 3)}
    goals = coarse.goals(x, "lulc", "seen", "ha", (1, 2, 3))
    goals = goals.withColumn("goal", F.when((F.col("cr") == 1) & (F.col("class_id") == 2), float("nan")).otherwise(F.col("goal").cast("double")))
    found = allocate.diagnostics(x, own, goals, level=11)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found["projected"], found["rank"], allocate.allocate_gridded(x, own, goals))]
    assert [p.count(", 18), REPARTITION_BY_NUM") for p in plans] == [2, 1, 4]  # 300 cells of 3 classes
    assert not any(re.search(r"hashpartitioning\([^)]*class_id", p) for p in plans[:2])
    rows = lambda df: sorted(map(tuple, df.collect()))
    scored = allocate.suitability(x, own)
    taken = allocate.claims(scored, goals)
    assert rows(found["projected"]) == rows(allocate.apply(x, allocate.winners(taken))) == rows(allocate.allocate_gridded(x, own, goals))
    assert rows(found["allocation"]) == rows(taken.select("r", "c", "class_id")) != []
    assert rows(found["suitability"]) == rows(scored) and rows(found["rank"]) == rows(allocate.rank_output(scored))
    assert list(allocate.diagnostics(x, own, goals, level=4)) == ["projected"] and not allocate.diagnostics(x, own, goals, level=3)


@pytest.mark.parametrize("method", ["gridded", "exclusive", "matrix"])
def test_every_method_through_the_plan(spark, method):
    x = made(spark)
    own = {k: [("a", allocate.ADDITIVE, 1.0), ("m", allocate.MULTIPLICATIVE, 0.5)] for k in (1, 2, 3)}
    goals = coarse.change_matrix(x, "lulc", "seen", (1, 2, 3)) if method == "matrix" else coarse.goals(x, "lulc", "seen", "ha", (1, 2, 3))
    got = {(r["r"], r["c"]): r["lulc"] for r in pipeline.project(x, own, goals, method=method).collect()}
    run = {"gridded": allocate.allocate_gridded, "exclusive": allocate.allocate_exclusive, "matrix": allocate.allocate_from_matrix}[method]
    assert got == {(r["r"], r["c"]): r["lulc"] for r in run(x, own, goals).collect()} and len(got) == 300
