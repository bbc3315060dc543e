import numpy as np

from cellforge import catalog
from cellforge.plans import pipeline, zones
from cellforge.sources import grids, ranges
from cellforge.streaming.changes import stream_cells, stream_change_matrix
from oracle import SMALL


def test_text_grid_and_array(spark, tmp_path):
    (tmp_path / "a.asc").write_text("ncols 3\nnrows 2\nNODATA_value -9999\n1 2 -9999\n4 5 6\n")
    got = {(r["r"], r["c"]): r["value"] for r in grids.read_ascii_grid(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (0, 2): None, (1, 0): 4, (1, 1): 5, (1, 2): 6}
    np.save(tmp_path / "b.npy", np.array([[1.0, np.nan]]))
    assert [r["value"] for r in ranges.read_npy(spark, str(tmp_path / '*.npy')).orderBy("c").collect()] == [1.0, None]
    assert grids.list_files(spark, str(tmp_path), "*.asc").count() == 1


def test_partitioned_grid_is_kept(spark, tmp_path):
    x = spark.createDataFrame([(0, 0, None, 2000), (0, 1, 3, 2000)], "r int, c int, v int, year int")
    grids.write_grid(x, str(tmp_path / "g"), ("year",), nodata=255, value="v")
    grids.write_grid(x.limit(0), str(tmp_path / "g"), ("year",))
    back = grids.read_grid(spark, str(tmp_path / "g"), 255, "v").orderBy("c").collect()
    assert [r["v"] for r in back] == [None, 3]


def test_coefficients_round_trip(spark, tmp_path):
    x = spark.createDataFrame([("sand", "p", "additive", "class_1", 1.5), ("sand", "p", "additive", "class_2", -2.0)], "layer string, location string, kind string, class_label string, beta double")
    grids.write_coefficients(x, str(tmp_path / "c"), ["class_1", "class_2"])
    assert sorted(map(tuple, grids.read_coefficients(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, x.collect()))
    z = spark.createDataFrame([("z1", 3, 4)], "zone_id string, r int, c int")
    grids.write_zone_lookup(z, str(tmp_path / "z"))
    assert spark.read.text(str(tmp_path / "z")).first()[0] == "z1,3_4"
    grids.write_blocks(z, str(tmp_path / "b"))
    assert grids.read_blocks(spark, str(tmp_path / "b"), "zone_id string, r int, c int").collect() == z.collect()


def test_plan_from_states_to_map(spark):
    states = catalog.states(spark, SMALL)
    goals = pipeline.class_goals(states, catalog.coarse_area(states), 1995, 1996, {v: k for k, v in {1: "urban", 2: "cropland", 3: "grassland", 4: "forest", 5: "nonforestnatural"}.items()})
    x = catalog.layered(spark, SMALL)
    out = pipeline.project(x, catalog.COEFFICIENTS, goals, "t1")
    assert out.count() == x.count()
    base = catalog.detailed(spark, SMALL).withColumnRenamed("t1", "lulc")
    assert pipeline.restored_map(base, out).count() == x.count()


def test_dictionaries_and_checks(spark):
    rows = zones.flatten_paths(spark, {"a": {"2030": {"p": "x.tif"}}, "b": {"2050": {"p": "y.tif"}}}, ["scenario", "year", "policy"]).collect()
    assert {r["path"] for r in rows} == {"x.tif", "y.tif"}
    try:
        zones.check_layers(spark.createDataFrame([("s",)], "state string"))
        raise AssertionError
    except ValueError:
        pass


def test_stream_equals_batch(spark, tmp_path):
    x = catalog.cells(spark, SMALL).select("cr", "cc", "t1", "t2")
    x.repartition(3).write.parquet(str(tmp_path / "in"))
    s = stream_cells(spark, str(tmp_path / "in"), "cr int, cc int, t1 int, t2 int")
    q = stream_change_matrix(s, "t1", "t2", (1, 2, 3, 4, 5)).writeStream.outputMode("complete").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("changes").collect())) == sorted(map(tuple, catalog.change_matrix(spark, SMALL).collect()))
