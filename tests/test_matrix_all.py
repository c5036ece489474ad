"""The training matrix over all rows of its window, against its check SQL."""

from pathlib import Path

import duckdb
from test_queries import compare

from barloom.plans import catalog

SF = "/root/testdata/sf0.01"


def test_all_rows_of_the_window(spark):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    sql = catalog.oracles()["matrix_rolling_all"]
    assert "limit 1500" not in sql and con.sql(f"select count(*) from ({sql})").limit(1).fetchall()[0][0] > 1500
    said = compare(catalog.queries()["matrix_rolling_all"](spark, SF), con.sql(sql))
    assert said.startswith("ok"), said
