"""Differences between two copies of a table, field by field.

Both sides become key-field-value cells; a cell counts +1 on the left and -1 on the right. Cells are made distinct per
side, so rows that one copy holds twice count once. Cells and keys whose counts don't cancel are the differences.

The first aggregation is on the whole cell and combines before the shuffle, so a key that holds a large part of the
rows is spread by its values and reduced early; only cells that don't cancel reach the second one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PRESENT = "\u0001present"


def cents(name: str) -> Column:
    """Amount rounded to the cent as text; null stays null. Amounts beyond decimals keep their own text."""
    rounded = F.round(F.col(name).cast("double"), 2) + F.lit(0.0)
    return F.coalesce(F.expr(f"cast(try_cast(round(`{name}`, 2) as decimal(38,2)) as string)"), rounded.cast("string"))


def text_key(name: str) -> Column:
    return F.lower(F.trim(F.col(name)))


def plain_text(name: str) -> Column:
    """Letter case and surrounding blanks don't count."""
    return F.lower(F.trim(F.col(name)))


def text_set(name: str) -> Column:
    """An array as a set: members by lower-case trimmed text, sorted; null stays null, an empty list is empty."""
    members = F.transform(F.col(name), lambda x: F.lower(F.trim(x)))
    return F.to_json(F.array_sort(F.array_distinct(members)))


def _cells(df: DataFrame, key: Column, fields: dict[str, Column], sign: int) -> DataFrame:
    cell = [F.struct(F.lit(_PRESENT).alias("field"), F.lit("").alias("value"))]
    cell += [F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()]
    sided = df.select(key.alias("_key"), F.explode(F.array(*cell)).alias("_cell"))
    return sided.select("_key", "_cell.field", "_cell.value", F.lit(sign == 1).alias("_left"), F.lit(sign == -1).alias("_right"))


def differing_cells(left: DataFrame, right: DataFrame, key: Column, fields: dict[str, Column]) -> DataFrame:
    """Cells that one side lacks: ``_key``, ``field``, ``value``, ``signed`` (+1 left only, -1 right only).

    A null key is a key of its own. Null values equal only null. The pseudo field of presence marks keys.
    """
    both = _cells(left, key, fields, 1).unionByName(_cells(right, key, fields, -1))
    return (
        both.groupBy("_key", "field", "value")
        .agg((F.max("_left").cast("int") - F.max("_right").cast("int")).alias("signed"))
        .filter(F.col("signed") != 0)
    )


def table_differences(left: DataFrame, right: DataFrame, key: Column, fields: dict[str, Column], missing_left: str, missing_right: str) -> DataFrame:
    """``_key`` and ``difference``: a missing side, or else each field in which the sides differ.

    Fields of keys that one side lacks are not listed. Empty sides make every key of the other one missing.
    """
    open_cells = differing_cells(left, right, key, fields)
    per_key = open_cells.groupBy("_key").agg(
        F.sum(F.when(F.col("field") == _PRESENT, F.col("signed"))).alias("_side"), F.collect_set("field").alias("_fields")
    )
    side = F.col("_side")
    listed = F.when(side == 1, F.array(F.lit(missing_right))).when(side == -1, F.array(F.lit(missing_left))).otherwise(F.col("_fields"))
    return per_key.select("_key", F.explode(listed).alias("difference"))


def reconciliation_fields() -> dict[str, Column]:
    return {
        "discrepancy_type": plain_text("discrepancy_type"),
        "sources_reporting": text_set("sources_reporting"),
        "min_amount": cents("min_amount"),
        "max_amount": cents("max_amount"),
        "resolved_amount": cents("resolved_amount"),
    }


def reconciliation_differences(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Differences between the two copies of the reconciliation results; ``detected_at`` is not compared."""
    found = table_differences(
        primary, replica, text_key("external_reference_id"), reconciliation_fields(), "missing_in_primary", "missing_in_replica"
    )
    return found.withColumnRenamed("_key", "external_reference_id")
