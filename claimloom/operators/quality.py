"""Data-quality checks: all checks of a table in one pass, one row per check."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    name: str
    failed: Column  # aggregate: number of failed rows
    passed: Column | None = None  # aggregate; by default nothing failed


def not_null(column: str) -> Check:
    return Check(f"not_null:{column}", F.count_if(F.col(column).isNull()))


def unique(*keys: str) -> Check:
    """Rows beyond one per distinct key; null is a value."""
    distinct = F.count_distinct(F.struct(*[F.struct(F.col(k).isNull(), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in keys]))
    return Check(f"unique:{','.join(keys)}", F.count(F.lit(1)) - distinct)


def in_range(column: str, low, high) -> Check:
    """Bounds are inclusive; null passes."""
    return Check(f"range:{column}", F.count_if((F.col(column) < low) | (F.col(column) > high)))


def allowed(column: str, values) -> Check:
    """Null passes."""
    return Check(f"allowed_values:{column}", F.count_if(~F.col(column).isin(*values)))


def fresh(column: str, most: timedelta, as_of: datetime) -> Check:
    """An empty table fails."""
    latest = F.unix_micros(F.max(column))
    bound = F.unix_micros(F.lit(as_of)) - F.lit(most // timedelta(microseconds=1))
    stale = F.coalesce((latest < bound).cast("int"), F.lit(1))
    return Check(f"freshness:{column}", stale.cast("long"))


def run_checks(df: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """``check_name``, ``table_name``, ``passed``, ``failed_rows``: one aggregation over ``df`` for all checks."""
    sums = df.agg(*[c.failed.cast("long").alias(f"c{i}") for i, c in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(c.name).alias("check_name"), F.lit(table).alias("table_name"), (F.col(f"c{i}") == 0).alias("passed"), F.col(f"c{i}").alias("failed_rows")) for i, c in enumerate(checks)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def allowed_by(df: DataFrame, table: str, column: str, values: DataFrame) -> DataFrame:
    """The result of an allow-list that is itself a table (its column ``column``); null passes."""
    failed = df.filter(F.col(column).isNotNull()).join(values.select(column).distinct(), column, "left_anti")
    n = failed.agg(F.count(F.lit(1)).alias("failed_rows"))
    return n.select(F.lit(f"allowed_values:{column}").alias("check_name"), F.lit(table).alias("table_name"), (F.col("failed_rows") == 0).alias("passed"), "failed_rows")


def dq_summary(results: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """One row: checks, failed checks, and discrepancies by type."""
    none = F.lit(0).cast("long")
    kinds = ("amount_mismatch", "missing_in_source")
    checks = results.agg(F.count(F.lit(1)).alias("dq_checks_total"), F.count_if(~F.col("passed")).alias("dq_checks_failed"))
    found = reconciliation.agg(*[F.count_if(F.col("discrepancy_type") == k).alias(f"{k}_count") for k in kinds])
    names = ["dq_checks_total", "dq_checks_failed", *[f"{k}_count" for k in kinds]]
    both = [d.select(*[(F.col(n) if n in d.columns else none).alias(n) for n in names]) for d in (checks, found)]
    return both[0].unionByName(both[1]).agg(*[F.sum(n).alias(n) for n in names])


def pass_rate_by_layer(results: DataFrame) -> DataFrame:
    """The layer is the first part of the table's name."""
    layer = F.substring_index("table_name", ".", 1)
    return results.groupBy(layer.alias("layer")).agg(F.count_if("passed").alias("passed_checks"), F.count(F.lit(1)).alias("checks"), (F.count_if("passed") / F.count(F.lit(1))).alias("pass_rate"))


def persist_results(store, name: str, results: DataFrame, checked_at: Column) -> bool:
    """Appends results and tells whether all passed; failed checks never raise."""
    rows = results.withColumn("_checked_at", checked_at).persist()
    try:
        store.append(name, rows)
        return rows.filter(~F.col("passed")).isEmpty()
    finally:
        rows.unpersist()
