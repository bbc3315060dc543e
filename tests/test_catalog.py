import pytest

from cellforge import catalog
from oracle import SMALL, differs


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, name):
    assert differs(spark, catalog.QUERIES[name], catalog.SQL[name]) == ""


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_blocks_of_any_size(spark):
    from cellforge.operators import kernels

    x = catalog.cells(spark, SMALL)
    a, b = (kernels.convolve(x, "x1", kernels.kernel_array(1.0), 9, block=n).withColumnRenamed("value", f"v{n}") for n in (32, 256))
    assert a.join(b, ["r", "c"]).where("abs(v32 - v256) > 1e-9").count() == 0 and a.count() == x.count()
    n = catalog.n_rows(x)
    a, b = (kernels.gaussian_blur(x, ["x1"], 3, n, catalog.COLS, block=k).withColumnRenamed("x1", f"v{k}") for k in (16, 256))
    assert a.join(b, ["r", "c"]).where("abs(v16 - v256) > 1e-9").count() == 0 and a.count() == b.count()
