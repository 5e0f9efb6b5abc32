"""Every query runs over the smallest tables; those with SQL agree with it."""

import os

import duckdb
import pytest

from paneloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text(v):
    if v is None or v != v:
        return "-"
    if isinstance(v, float):
        return f"{v:.7g}"
    return str(v)[:10] if str(v).endswith(" 00:00:00") else str(v)


def canonical(rows):
    return sorted(tuple(map(text, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = canonical(df.select(*columns).collect())
    if name in registry.ORACLES:
        rel = con.execute(registry.ORACLES[name])
        names = [c[0] for c in rel.description]
        rows = rel.fetchall()
        assert sorted(names) == columns
        assert got == canonical([[r[names.index(c)] for c in columns] for r in rows])
    else:
        assert got
