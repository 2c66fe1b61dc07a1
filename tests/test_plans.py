"""Every plan of the core gives the rows of its SQL; plans without SQL give rows."""

import pytest

from splitforge.plans import registry

from .compare import connect, same

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_plan(spark, con, name):
    df = registry.queries()[name](spark, FOLDER)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.collect()
    spark.catalog.clearCache()


def test_entry_summarises_every_condition(spark):
    import __spark_entry__
    from splitforge.operators import corrupt

    rows = __spark_entry__.entry(spark).collect()
    assert sorted((r.model, r.name, r.param) for r in rows) == sorted((m, n, p) for m in ("baseline", "robust") for n, p, _ in corrupt.SWEEP)
    spark.catalog.clearCache()


def test_steps_of_small_amounts_are_written_as_in_sql(spark, con):
    """A sharpening by nearly nothing, which one vector in a thousand draws and sf0.001 has none of."""
    from pyspark.sql import functions as F
    from splitforge.plans.files import _six_places

    values = [0.000137, -0.00098, 3.9e-05, -1e-05, 0.000001, 2.4e-07, -2.4e-07, 0.0, 0.0001, 0.00009950001, 0.001, 30.0, 76.6106774, 0.5, -0.6, 94.9999999]
    made = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(_six_places(F.col("v")).alias("x")).collect()]
    assert made == [con.execute(f"SELECT '' || round({v!r}::DOUBLE, 6)").fetchone()[0] for v in values]


def test_image_files_are_decoded_once(spark):
    """What v8_readability returns reads what a single pass over the files has left."""
    df = registry.queries()["v8_readability"](spark, FOLDER)
    assert "FileScan image" not in df._jdf.queryExecution().toString() and df.first().decoded > 0
