import os

import duckdb
import pytest

from quillon.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("name", ["unit_temperature", "si_prefix", "table1d_clamp", "table2d_clamp", "spmv", "matrix_set", "net_star", "fluid_isobaric", "floatmap_lookup", "plot_normalize", "voxel_master"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(plans.ORACLES[name]).df()
    got = plans.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    key = lambda row: tuple(str(x) for x in row)
    rows = [sorted(map(tuple, df.itertuples(index=False)), key=key) for df in (got, want)]
    assert len(rows[0]) == len(rows[1])
    for a, b in zip(*rows, strict=True):
        assert list(a) == pytest.approx(list(b)) if all(isinstance(x, (int, float)) for x in a) else list(map(str, a)) == list(map(str, b)) or a == b


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(plans.QUERIES) <= set(e.queries())
