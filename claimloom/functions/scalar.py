"""Column functions of the claim layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cause codes and their labels, and movement codes by what they mean.
CAUSES = {1: "roubo_furto", 2: "roubo", 3: "furto", 4: "colisao_parcial", 5: "colisao_indenizacao_integral", 6: "incendio", 7: "assistencia_24h", 9: "outros"}
OTHER_CAUSE = "outros"
INCLUSIONS = (11, 12, 13, 14, 16, 17, 71)
CANCELLATIONS = (41, 42, 43, 44, 45, 46, 47, 48, 72, 73, 74)


def decimal_comma(c: Column) -> Column:
    """``R$ 1.234,56`` as decimal(18,2); null where it is no amount."""
    bare = F.regexp_replace(c, r"R\$\s*|\.", "")
    return F.translate(bare, ",", ".").try_cast("decimal(18,2)")


def currency_ptbr(c: Column) -> Column:
    """A number as ``R$ 1.234,56``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))


def finite(c: Column) -> Column:
    """Text or number as double; NaN and unreadable text give null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def without_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def cents(c: Column) -> Column:
    """A whole number of cents as decimal(18,2); scientific notation is read, fractions of a cent are cut off."""
    return (finite(c).try_cast("bigint").cast("decimal(20,0)") / 100).try_cast("decimal(18,2)")


def epoch_millis(c: Column) -> Column:
    """Milliseconds since 1970 as timestamp, to the second."""
    return F.timestamp_seconds(F.floor(finite(c).try_cast("bigint") / 1000))


def decode_cause(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CAUSES.items() for x in pair])
    return F.coalesce(F.element_at(known, code.try_cast("int")), F.lit(OTHER_CAUSE))


def movement_event(code: Column) -> Column:
    number = code.try_cast("int")
    return F.when(number.isin(*INCLUSIONS), "policy-created").when(number.isin(*CANCELLATIONS), "policy-cancelled").otherwise("policy-updated")


def natural_key(*parts: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the parts, joined by bars; null if any part is null."""
    joined = F.concat(*[x for p in parts for x in (F.lit("|"), p.cast("string"))][1:])
    return F.substring(F.sha2(joined, 256), 1, 24)


def masked(c: Column, visible: bool) -> Column:
    return c if visible else F.sha2(c.cast("string"), 256)
