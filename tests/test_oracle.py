"""Every query that has SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from gradeloom.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.load()


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    text = lambda v: "NULL" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT") else (repr(round(float(v), 7)) if isinstance(v, float) else str(v))
    return sorted(tuple(text(v if not hasattr(v, "item") else v.item()) for v in r) for r in pdf.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got.astype(object)), rows_of(want.astype(object))
    assert len(a) == len(b)
    loose = lambda r: tuple(v[:-2] if v.endswith(".0") else v for v in r)
    assert sorted(map(loose, a)) == sorted(map(loose, b))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
