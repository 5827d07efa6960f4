"""Mixed timestamp notations and zones, normalised to one UTC instant in microseconds.

Parsing is built from column expressions only. Each notation yields civil fields and, where stated, a zone; bare counts
yield the instant at once. Civil fields without zone are converted with the zone history of their source. That history
is chosen among all zones that the runtime knows: reports are aligned with their arrival and with zoned reports of the
same event, and the history with the fewest violations wins; a declared zone decides ties and sources without evidence.

Texts are parsed once and stored. For the choice, reports are reduced to counts by source, local hour and the offset that
their alignment implies, so that a zone is tried on hours of the calendar and not on reports.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.session import dealt, salted_join, stored

# Usual meaning of zone abbreviations as offsets.
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00",
    "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00",
    "BRT": "-03:00", "BRST": "-02:00", "AMT": "-04:00", "AMST": "-03:00", "FNT": "-02:00", "ACT": "-05:00", "ART": "-03:00",
    "MEZ": "+01:00", "MESZ": "+02:00", "MSK": "+03:00", "JST": "+09:00", "KST": "+09:00", "AEST": "+10:00", "AEDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00",
    "CLT": "-04:00", "CLST": "-03:00", "COT": "-05:00", "PET": "-05:00", "UYT": "-03:00", "PYT": "-04:00", "BOT": "-04:00", "VET": "-04:00",
    "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00", "AST": "-04:00", "ADT": "-03:00", "NST": "-03:30", "NDT": "-02:30",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}

# Month names by their first three letters, in English, Portuguese, Spanish, French, German and Italian; and
# the two that need four.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "fev": 2, "abr": 4, "mai": 5, "ago": 8, "set": 9, "out": 10, "dez": 12, "ene": 1, "dic": 12, "fév": 2, "avr": 4, "aoû": 8, "aou": 8, "déc": 12,
    "jän": 1, "mär": 3, "mrz": 3, "mae": 3, "okt": 10, "gen": 1, "mag": 5, "giu": 6, "lug": 7, "ott": 10,
}
LONG_MONTHS = {"juin": 6, "juil": 7}

_ZONE = r"(?:\s*(Z|[A-Z]{2,5}|(?:UTC|GMT)?[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2}))?"
_CLOCK = r"([0-9]{1,2})[:.H]([0-9]{2})(?:[:.]([0-9]{2})(?:[.,]([0-9]{1,9}))?)?(?:\s*([AP])\.?M\.?)?"
# Groups 1-3 are date parts, then hour, minute, second, fraction, half of day, zone.
_YEAR_FIRST = rf"^([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})(?:[T\s]+{_CLOCK}{_ZONE})?$"
_YEAR_LAST = rf"^([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{4}}|[0-9]{{2}})(?:[T\s,]+{_CLOCK}{_ZONE})?$"
_DAY_MONTH = rf"^(?:\p{{L}}{{2,9}}\.?,?\s+)?([0-9]{{1,2}})\s+(?:DE\s+)?(\p{{L}}{{3,9}})\.?\s+(?:DE\s+)?([0-9]{{4}})(?:[\s,]+{_CLOCK}{_ZONE})?$"
_MONTH_DAY = rf"^(?:\p{{L}}{{2,9}}\.?,?\s+)?(\p{{L}}{{3,9}})\.?\s+([0-9]{{1,2}}),?\s+([0-9]{{4}})(?:[\s,]+{_CLOCK}{_ZONE})?$"
_DIGITS = r"^([0-9]{4})([0-9]{2})([0-9]{2})(?:([0-9]{2})([0-9]{2})([0-9]{2}))?$"
_WRAPPED = r"^/DATE\((-?[0-9]{1,16})(?:[+-][0-9]{4})?\)/$"
_EXPONENT = r"^[0-9](?:\.[0-9]+)?E\+?[0-9]{1,2}$"


def _int(text: Column) -> Column:
    return F.nullif(text, F.lit("")).cast("int")


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _offset(zone: Column) -> Column:
    """A stated zone as ``±hh:mm``; unknown abbreviations give null."""
    bare = F.regexp_replace(zone, r"^(?:UTC|GMT)(?=[+-])", "")
    hours = F.concat(F.substring(bare, 1, 3), F.lit(":"))
    return (
        F.when(bare.rlike(r"^[+-](?:0[0-9]|1[0-8]):?[0-5][0-9]$"), F.concat(hours, F.substring(bare, -2, 2)))
        .when(bare.rlike(r"^[+-](?:0[0-9]|1[0-8])$"), F.concat(hours, F.lit("00")))
        .otherwise(_lookup(ABBREVIATIONS, bare))
    )


def _tidy(text: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(text, r"[\s\u00a0\u202f]+", " ")))


def canonical(v: Column, order: Column) -> Column:
    """The notation of ``v`` (tidied text) reduced to one layout: a kind and its parts, separated by bars; null if unknown.

    ``C`` has year, month, day, hour, minute, second, fraction, half of day and zone; ``S``, ``L``, ``U`` and ``E`` have
    a count since 1970 in seconds, milliseconds, microseconds, or milliseconds in exponent notation.
    """
    plain, size = v.rlike("^[0-9]+$"), F.length(v)
    clock = "|$4|$5|$6|$7|$8|$9"
    into = lambda pattern, parts: F.regexp_replace(v, pattern, parts)
    month_first = F.upper(F.trim(order)) == "MDY"
    return (
        F.when(plain & size.isin(8, 14), into(_DIGITS, "C|$1|$2|$3|$4|$5|$6|||"))
        .when(plain & (size == 10), F.concat(F.lit("S|"), v))
        .when(plain & (size == 13), F.concat(F.lit("L|"), v))
        .when(plain & (size == 16), F.concat(F.lit("U|"), v))
        .when(v.rlike(_YEAR_FIRST), into(_YEAR_FIRST, "C|$1|$2|$3" + clock))
        .when(v.rlike(_YEAR_LAST) & month_first, into(_YEAR_LAST, "C|$3|$1|$2" + clock))
        .when(v.rlike(_YEAR_LAST), into(_YEAR_LAST, "C|$3|$2|$1" + clock))
        .when(v.rlike(_EXPONENT), F.concat(F.lit("E|"), v))
        .when(v.rlike(_WRAPPED), into(_WRAPPED, "L|$1"))
        .when(v.rlike(_DAY_MONTH), into(_DAY_MONTH, "C|$3|$2|$1" + clock))
        .when(v.rlike(_MONTH_DAY), into(_MONTH_DAY, "C|$3|$1|$2" + clock))
    )


def with_parsed(df: DataFrame, text: Column, order: Column, name: str = "_civil") -> DataFrame:
    """Adds a struct of what ``text`` states: ``instant_us`` for bare counts; else ``year month day hour minute second``
    (second as decimal), ``offset`` (null: none stated) and ``readable``. ``order`` is DMY, MDY or YMD and tells how
    numeric dates with the year last are read (day first unless MDY). Blank, null and unknown texts give null.

    The one-element explodes keep the optimizer from repeating the parse for every use of a part.
    """
    tidy = df.withColumn("__text", F.explode(F.array(_tidy(text))))
    parts = tidy.withColumn("__canonical", F.explode(F.array(canonical(F.col("__text"), order)))).withColumn("__parts", F.split("__canonical", r"\|", -1))
    at = lambda i: F.get(F.col("__parts"), F.lit(i))
    kind, count = at(0), at(1)
    is_civil = kind == "C"
    instant = (
        F.when(kind == "S", F.try_multiply(count.try_cast("long"), F.lit(1_000_000)))
        .when(kind == "L", F.try_multiply(count.try_cast("long"), F.lit(1_000)))
        .when(kind == "U", count.try_cast("long"))
        .when(kind == "E", F.floor(F.try_multiply(count.try_cast("decimal(28,6)"), F.lit(1_000))).try_cast("long"))
    )
    year = F.when(F.length(at(1)) == 2, F.concat(F.lit("20"), at(1))).otherwise(at(1))
    month = F.when(at(2).rlike("^[0-9]"), F.nullif(at(2), F.lit("")).try_cast("int")).otherwise(F.coalesce(_lookup(LONG_MONTHS, F.lower(F.substring(at(2), 1, 4))), _lookup(MONTHS, F.lower(F.substring(at(2), 1, 3)))))
    hour, half, zone = _int(at(4)), at(8), F.nullif(at(9), F.lit(""))
    hour24 = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0)).otherwise(F.lit(99))
    second = F.concat(F.coalesce(F.nullif(at(6), F.lit("")), F.lit("0")), F.lit("."), F.substring(F.rpad(at(7), 6, "0"), 1, 6))
    civil = F.struct(
        instant.alias("instant_us"),
        F.when(is_civil, _int(year)).alias("year"),
        F.when(is_civil, month).alias("month"),
        F.when(is_civil, _int(at(3))).alias("day"),
        F.when(is_civil, F.coalesce(hour24, F.lit(0))).alias("hour"),
        F.when(is_civil, F.coalesce(_int(at(5)), F.lit(0))).alias("minute"),
        F.when(is_civil, second.try_cast("decimal(8,6)")).alias("second"),
        F.when(is_civil & zone.isNotNull(), _offset(zone)).alias("offset"),
        F.when(is_civil, zone.isNull() | _offset(zone).isNotNull()).otherwise(instant.isNotNull()).alias("readable"),
    )
    one = F.when(F.col("__canonical").isNotNull(), civil)
    return parts.withColumn(name, F.explode(F.array(one))).drop("__text", "__canonical", "__parts")


def instant_us(civil: Column, zone: Column) -> Column:
    """The UTC instant of a struct of ``with_parsed``. Impossible dates and times give null.

    Of a local time that occurs twice the earlier instant counts; one that a clock change skips is read with the
    offset from before the change.
    """
    ok = civil["readable"] & civil["hour"].between(0, 23) & civil["minute"].between(0, 59) & (civil["second"] < 60)
    at = F.try_make_timestamp(civil["year"], civil["month"], civil["day"], civil["hour"], civil["minute"], civil["second"], F.coalesce(civil["offset"], zone))
    return F.coalesce(civil["instant_us"], F.when(ok, F.unix_micros(at)))


_QUARTER, _HOUR_US = 15 * 60 * 1_000_000, 3_600_000_000
#: Offsets are whole quarters of an hour; this one is none, and no zone has it.
_NO_OFFSET = 999


def known_zones(spark: SparkSession) -> list[str]:
    """UTC and all zones with a place name that the runtime knows."""
    names = spark._jvm.java.time.ZoneId.getAvailableZoneIds().toString().strip("[]").split(", ")
    return ["UTC", *sorted(n for n in names if "/" in n and not n.startswith(("Etc/", "SystemV/")))]


def alignments(reports: DataFrame, slack_us: int = 1_000_000) -> DataFrame:
    """Reports with local time as counts ``n`` by ``_source``, local ``hour`` since 1970, ``offset`` and ``least``, in quarters
    of an hour: the offset from UTC that zoned reports of the same event imply (null without any, ``_NO_OFFSET`` if none
    fits them), and the least offset with which the report doesn't lie after its arrival.

    Events are reduced to their earliest and latest zoned instant before the join, and a popular identifier is spread.
    """
    stated = F.col("_civil.instant_us").isNotNull() | F.col("_civil.offset").isNotNull()
    utc = instant_us(F.col("_civil"), F.lit("UTC"))
    anchors = (
        reports.filter(stated & F.col("_event").isNotNull())
        .select("_event", utc.alias("_t"))
        .filter(F.col("_t").isNotNull())
        .groupBy("_event")
        .agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
        .filter(F.col("_hi") - F.col("_lo") <= 60_000_000)
    )
    local = reports.filter(~stated & F.col("_civil.readable"))
    # Midnight often stands for an unknown time.
    local = local.filter((F.col("_civil.hour") > 0) | (F.col("_civil.minute") > 0) | (F.col("_civil.second") > 0))
    local = local.select("_source", "_event", "_arrived", utc.alias("_local")).filter(F.col("_local").isNotNull())
    joined = salted_join(local, anchors, "_event", F.struct("_local", "_arrived"))
    at, margin = F.col("_local"), 60_000_000 + slack_us
    offset = F.round((at - (F.col("_lo") + F.col("_hi")) / 2) / _QUARTER).cast("int")
    ahead = offset.cast("long") * F.lit(_QUARTER)
    fits = (ahead >= at - F.col("_hi") - margin) & (ahead <= at - F.col("_lo") + margin)
    least = F.greatest(F.least(F.ceil((at - F.col("_arrived")) / _QUARTER), F.lit(60)), F.lit(-60)).cast("int")
    return joined.groupBy(
        "_source",
        F.floor(at / _HOUR_US).cast("long").alias("hour"),
        F.when(F.col("_lo").isNotNull(), F.when(fits, offset).otherwise(_NO_OFFSET)).alias("offset"),
        F.coalesce(least, F.lit(-60)).alias("least"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _offsets(zone: ZoneInfo, hours):
    """Quarters of an hour that ``zone`` is ahead of UTC in each of the distinct local ``hours``. Only the hours of days on
    which the offset changes are looked up one by one."""
    import numpy as np

    epoch, quarter = datetime(1970, 1, 1, tzinfo=zone), timedelta(minutes=15)

    def at(hour: int) -> int:
        try:
            return round((epoch + timedelta(hours=hour)).utcoffset() / quarter)
        except OverflowError:
            return _NO_OFFSET

    days = hours // 24
    borders = np.unique(np.concatenate([days, days + 1]))
    ahead = np.array([at(d * 24) for d in borders.tolist()])
    first = np.searchsorted(borders, days)
    out = ahead[first]
    for i in np.flatnonzero(out != ahead[first + 1]).tolist():
        out[i] = at(int(hours[i]))
    return out


#: Days on which zones are tried first.
_PROBED = 24


def _try_zones(zones: Sequence[str]):
    def tried(rows):
        import numpy as np
        import pandas as pd

        source, declared = rows["_source"].iloc[0], rows["_declared"].iloc[0]
        names = [*zones, declared] if isinstance(declared, str) and declared not in zones else zones
        hours, place = np.unique(rows["hour"].to_numpy(), return_inverse=True)
        offset, least, n = rows["offset"].to_numpy(float), rows["least"].to_numpy(), rows["n"].to_numpy()
        aligned = ~np.isnan(offset)

        def violations(zone: ZoneInfo, some) -> int:
            kept, at = np.unique(place[some], return_inverse=True)
            ahead = _offsets(zone, hours[kept])[at]
            broken = (aligned[some] & (offset[some] != ahead)) | (ahead < least[some])
            return int(n[some][broken].sum())

        # Violations on a few days bound those on all days from below: what is worse there than the best can't win.
        days = np.unique(hours // 24)
        few = np.isin(hours[place] // 24, days[:: max(len(days) // _PROBED, 1)])
        bounds = []
        for name in names:
            try:
                bounds.append((violations(ZoneInfo(name), few), name))
            except (ZoneInfoNotFoundError, ValueError):
                continue
        out, best, every = [], None, np.ones(len(n), bool)
        for bound, name in sorted(bounds):
            if best is not None and bound > best:
                break
            found = violations(ZoneInfo(name), every)
            best = found if best is None else min(best, found)
            out.append((source, name, found, int(n[aligned].sum()), int(n.sum())))
        return pd.DataFrame(out, columns=["_source", "_zone", "violations", "aligned", "reports"])

    return tried


def zone_violations(reports: DataFrame, candidates: Sequence[str], declared: DataFrame | None = None, slack_us: int = 1_000_000) -> DataFrame:
    """Per source and candidate zone: reports with local time that fit no order of events. The zone that a source
    declares (``_source``, ``_declared``) is a candidate for it too.

    ``reports`` has ``_source``, ``_event`` (identifier of what is reported, may be null), ``_civil`` and ``_arrived``
    (microseconds). A converted report violates the order if it lies after its own arrival, or if zoned reports of the
    same event exist and none agrees with it: to the precision that it states. One task tries the zones of a source, on
    counts by hour, whose number the calendar bounds. Zones that can't have the fewest violations, and sources without
    reports in local time, have no row.
    """
    counts = alignments(reports, slack_us)
    counts = counts.join(declared, "_source", "left") if declared is not None else counts.withColumn("_declared", F.lit(None).cast("string"))
    return counts.groupBy("_source").applyInPandas(_try_zones(list(candidates)), "_source string, _zone string, violations long, aligned long, reports long")


#: Reports of a source that must be alignable before an estimate outranks a declaration, and the share of them that may violate it.
MIN_ALIGNED, MAX_VIOLATING = 30, 0.2


def choose_zones(violations: DataFrame, declared: DataFrame) -> DataFrame:
    """``_source``, ``_zone``, ``_estimated``, ``_declared``: per source the history with the fewest violations.

    Of equally good histories the declared one wins. Where the evidence is thin (few alignable reports, or many that
    fit no candidate) the declared zone stands. Without a declaration any alignable reports decide, else it is UTC.
    """
    best = (
        violations.join(declared, "_source", "left")
        .groupBy("_source")
        .agg(F.min(F.struct("violations", (~F.col("_zone").eqNullSafe(F.col("_declared"))).alias("other"), "_zone", "aligned")).alias("_best"))
    )
    needed = F.when(F.col("_declared").isNull(), 1).otherwise(MIN_ALIGNED)
    sound = (F.col("_best.aligned") >= needed) & (F.col("_best.violations") <= MAX_VIOLATING * F.col("_best.aligned"))
    estimated = F.when(sound, F.col("_best._zone"))
    return (
        declared.join(best, "_source", "full")
        .withColumn("_estimated", estimated)
        .select("_source", F.coalesce("_estimated", "_declared", F.lit("UTC")).alias("_zone"), "_estimated", "_declared")
    )


def _source_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def regulatory_reports(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """``record_id``, ``_source``, ``_event``, ``_arrived`` and ``_civil`` of each row, read from the source's own date field."""
    rules = sources.select(_source_name(F.col("source_system")).alias("_source"), "numeric_date_order", "date_field")
    fields = ("data_ocorrencia", "EVENT_DATE", "occurrenceDate")
    stated = F.coalesce(*[F.when(F.col("date_field") == n, F.col(n)) for n in fields])
    needed = raw.select("record_id", "external_reference_id", "kafka_timestamp", *fields, _source_name(F.col("source_system")).alias("_source"))
    rows = dealt(needed).join(rules, "_source")
    rows = rows.select(
        "record_id", "_source", F.lower(F.trim("external_reference_id")).alias("_event"), F.unix_micros("kafka_timestamp").alias("_arrived"),
        stated.alias("_stated"), F.col("numeric_date_order").alias("_order"),
    )
    return with_parsed(rows.filter(F.col("_stated").isNotNull()), F.col("_stated"), F.col("_order")).drop("_stated", "_order")


def source_zones(reports: DataFrame, sources: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    """The zone of each source among ``candidates``, or among all known zones."""
    declared = sources.select(_source_name(F.col("source_system")).alias("_source"), F.col("local_zone").alias("_declared"))
    return choose_zones(zone_violations(reports, candidates or known_zones(reports.sparkSession), declared), declared)


def regulatory_occurrences(raw: DataFrame, sources: DataFrame, candidates: Sequence[str] | None = None) -> DataFrame:
    """``record_id`` and ``occurred_us`` of every row whose time of loss is readable.

    Rows of unknown sources, null and unreadable texts give no row. Repeated rows each give one.
    """
    reports = stored(regulatory_reports(raw, sources))
    zones = source_zones(reports, sources, candidates).select("_source", "_zone")
    return (
        reports.join(zones, "_source")
        .select("record_id", instant_us(F.col("_civil"), F.col("_zone")).alias("occurred_us"))
        .filter(F.col("occurred_us").isNotNull())
    )
