"""The driver's contract: every query runs on the smallest tables and equals its SQL there."""

import datetime as dt
import decimal
import importlib.util
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

spec = importlib.util.spec_from_file_location("spark_entry", Path(__file__).resolve().parents[1] / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
CORE = [n for n in entry.queries() if entry.queries()[n].__module__.startswith("claimloom.plans")]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat() if v.tzinfo is None else v.astimezone(dt.timezone.utc).replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def tables(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, tables, name):
    df = entry.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name in entry.oracle_sql():
        answer = tables.execute(entry.oracle_sql()[name])
        names = [x[0] for x in answer.description]
        assert sorted(names) == columns
        assert got == Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in answer.fetchall())


def test_columns_of_the_found_queries(spark, small):
    want = {
        "p1_found": [("record_id", "bigint")], "p2_found": [("feed_id", "string"), ("file_no", "int"), ("change", "string"), ("old_field", "string"), ("new_field", "string")],
        "p3_found": [("record_id", "bigint"), ("occurred_us", "bigint")], "p4_found": [("policy_id", "string"), ("valid_from_us", "bigint"), ("valid_to_us", "bigint")],
        "p5_found": [("external_reference_id", "string"), ("difference", "string")], "p6_found": [("record_id", "bigint"), ("fate", "string")], "p7_found": [("line_id", "bigint"), ("_reason", "string")],
    }
    assert {n: entry.queries()[n](spark, small).dtypes for n in want} == want
