"""Every packaged query against its DuckDB SQL on the small tables."""

from pathlib import Path

import duckdb
import pytest

from quarryframe.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(df):
    cols = sorted(df.columns)
    text = df[cols].astype(str).replace({"<NA>": "nan", "None": "nan"})
    for c in cols:
        text[c] = text[c].str.replace(r"\.0$", "", regex=True).str.replace(r"^-0$", "0", regex=True)
    return text.sort_values(cols).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    a, b = plain(QUERIES[name](spark, DATA).toPandas()), plain(duck.sql(ORACLE[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert a.equals(b), a[(a != b).any(axis=1)].head(3)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
