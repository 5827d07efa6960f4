"""Column masks and row filters as views of what a set of groups may see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions.scalar import masked

MASKED = ("customer_id", "policy_id")


def mask_columns(df: DataFrame, groups: set[str], reader: str, columns: tuple[str, ...] = MASKED) -> DataFrame:
    """Members of ``reader`` see the values, others their SHA-256."""
    visible = reader in groups
    return df.withColumns({c: masked(F.col(c), visible) for c in columns if c in df.columns})


def region_visible(groups: set[str], admin: str, prefix: str = "insurance-region-") -> Column:
    """Admins see every row; others those of the regions that their groups name. A null region is for admins only."""
    if admin in groups:
        return F.lit(True)
    regions = sorted(g[len(prefix) :] for g in groups if g.startswith(prefix))
    return F.coalesce(F.lower("region").isin(*regions), F.lit(False)) if regions else F.lit(False)


def secured(df: DataFrame, groups: set[str], reader: str, admin: str) -> DataFrame:
    return mask_columns(df.filter(region_visible(groups, admin)), groups, reader)


def secured_view(store, spark, table: str, view: str, groups: set[str], reader: str, admin: str) -> bool:
    """Registers the view if the table exists; may be repeated."""
    if not store.exists(table):
        return False
    secured(store.read(table), groups, reader, admin).createOrReplaceTempView(view)
    return True
