"""Every query of the catalog gives the rows of its SQL."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from ratewise.plans import end_to_end as catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    """Sorted rows; floats by 12 figures."""
    text = lambda x: "null" if x is None or x is pd.NaT or x != x else f"{x:.12g}" if isinstance(x, float) else str(x)
    return sorted("|".join(text(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, name):
    mine, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert rows(mine) == rows(want)
