from pathlib import Path

import duckdb
import pytest

from harborlight.llm import queries

SF = "/root/testdata/sf0.001"


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the given tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_their_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    found = con.execute(queries.oracle_sql()[name])
    order = [c[0] for c in found.description]
    want = [tuple(map(plain, row)) for row in found.fetchall()]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(order)
    assert sorted(tuple(map(plain, row)) for row in got.select(order).collect()) == sorted(want)
