"""Every registered query against its SQL, run by another engine over the same files."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from orebed.plans.catalog import ORACLE_SQL, QUERIES


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.7g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"structured_chunks"} and len(QUERIES) > 200


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    rel = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = sorted(tuple(plain(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["bor_consolidate", "kac_median", "latest_order", "keyed_diff", "session_events", "rrf_fusion"])
def test_partitions_do_not_matter(name, spark, sf):
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, QUERIES[name](spark, sf).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
