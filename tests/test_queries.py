"""Every link query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))

from anchorage.plans import lesson_queries  # noqa: E402, F401
from anchorage.plans.queries import ORACLES, QUERIES  # noqa: E402


def values(frame) -> list[tuple]:
    def plain(x):
        if x is None or str(x) in ("NaT", "<NA>", "nan", "None"):
            return "null"
        if isinstance(x, float) and math.isfinite(x) and x == int(x):
            return str(int(x))
        return str(x.to_pydatetime() if hasattr(x, "to_pydatetime") else x)

    columns = sorted(frame.columns)
    return sorted(tuple(plain(x) for x in row) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got, expected = QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(expected.columns)
    assert values(got) == values(expected)
