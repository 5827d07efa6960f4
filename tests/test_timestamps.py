from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from claimloom.operators import timestamps as ts

SOURCES = [("insurer_a", "A", "America/Sao_Paulo", "DMY", "data_ocorrencia"), ("insurer_b", "B", "Europe/Lisbon", "MDY", "EVENT_DATE"), ("insurer_c", "C", "America/New_York", "YMD", "occurrenceDate")]
RAW = "record_id long, external_reference_id string, source_system string, data_ocorrencia string, EVENT_DATE string, occurrenceDate string, kafka_timestamp timestamp"


def sources(spark):
    return spark.createDataFrame(SOURCES, "source_system string, institution string, local_zone string, numeric_date_order string, date_field string")


def us(*args):
    return int(datetime(*args, tzinfo=timezone.utc).timestamp() * 1_000_000 + 0.5)


CASES = [
    ("a", "29/03/2018", us(2018, 3, 29, 3)), ("a", " 9/8/18 1h00 ", us(2018, 8, 9, 4)), ("a", "24-06-2018 05.11.49", us(2018, 6, 24, 8, 11, 49)),
    ("a", "14/01/2018 15:59 BRST", us(2018, 1, 14, 17, 59)), ("a", "27/10/2018 22:22 BRT", us(2018, 10, 28, 1, 22)), ("a", "12 out 2018 12:11", us(2018, 10, 12, 15, 11)),
    ("a", "2018-04-18T06:30:27-03:00", us(2018, 4, 18, 9, 30, 27)), ("a", "31/02/2018", None), ("a", "a confirmar", None), ("a", "", None), ("a", None, None),
    ("a", "17/02/2018 23:30:00", us(2018, 2, 18, 1, 30)),  # comes twice: the earlier one, of summer time
    ("a", "04/11/2018 00:30", us(2018, 11, 4, 3, 30)),  # skipped: offset from before the change
    ("b", "06/20/2018 07:38 PM", us(2018, 6, 20, 18, 38)), ("b", "13/01/2019 10:00 AM", None), ("b", "12/01/2018 12:05 AM", us(2018, 12, 1, 0, 5)), ("b", "01/02/2018 13:00 PM", None),
    ("b", "2018-02-18T04:12:31.469289Z", us(2018, 2, 18, 4, 12, 31) + 469289), ("b", "20180608073425", us(2018, 6, 8, 6, 34, 25)), ("b", "20180304", us(2018, 3, 4)), ("b", "00000000", None),
    ("b", "2019-09-12T13:43:21+0100", us(2019, 9, 12, 12, 43, 21)), ("b", "Oct 6, 2018 20:50", us(2018, 10, 6, 19, 50)), ("b", "2018-02-18 24:00:00", None), ("b", "2018-02-18 10:60", None),
    ("c", "1526542401336", 1526542401336000), ("c", "1.517611076501E12", 1517611076501000), ("c", "1556884387", 1556884387000000), ("c", "1517851966424418", 1517851966424418),
    ("c", "/Date(1509237369180)/", 1509237369180000), ("c", "/Date()/", None), ("c", "1.5E", None), ("c", "NaN", None), ("c", "2019-11-07T15:29Z", us(2019, 11, 7, 15, 29)),
    ("c", "Sat, 26 Oct 2019 06:05:35 -0400", us(2019, 10, 26, 10, 5, 35)), ("c", "2019-11-03T01:30:00.000", us(2019, 11, 3, 5, 30)), ("c", "2018-03-11T02:30:00.000", us(2018, 3, 11, 7, 30)),
    ("c", "2018-03-11T02:30:00 XYZ", None), ("c", "3 Okt 2019 10:00 MESZ", us(2019, 10, 3, 8)), ("c", "3 luglio 2019 10:00 CEST", us(2019, 7, 3, 8)), ("c", "3 juillet 2019 10:00Z", us(2019, 7, 3, 10)),
]


def raw(spark, cases):
    at = {"a": 0, "b": 1, "c": 2}
    rows = [(i, f"r{i}", f" INSURER_{s.upper()} ", *[t if at[s] == k else None for k in range(3)], datetime(2021, 1, 1)) for i, (s, t, _) in enumerate(cases)]
    return spark.createDataFrame(rows, RAW)


def test_every_notation(spark):
    got = {r.record_id: r.occurred_us for r in ts.regulatory_occurrences(raw(spark, CASES), sources(spark)).collect()}
    wrong = [(CASES[i], got.get(i)) for i in range(len(CASES)) if got.get(i) != CASES[i][2]]
    assert not wrong


def test_zone_is_found_without_declaration(spark):
    """Local reports of New York beside zoned reports of the same events, and no declared zone."""
    rows = []
    for i in range(60):
        utc = datetime(2019, 1 + i % 12, 1 + i % 28, 12, i, tzinfo=timezone.utc)
        from zoneinfo import ZoneInfo

        local = utc.astimezone(ZoneInfo("America/New_York")).strftime("%Y-%m-%dT%H:%M:%S")
        rows += [(2 * i, f"e{i}", "insurer_c", None, None, local, datetime(2021, 1, 1)), (2 * i + 1, f"e{i}", "insurer_b", None, utc.strftime("%Y-%m-%dT%H:%M:%SZ"), None, datetime(2021, 1, 1))]
    undeclared = sources(spark).withColumn("local_zone", F.lit(None).cast("string"))
    reports = ts.regulatory_reports(spark.createDataFrame(rows, RAW), undeclared)
    zones = {r._source: r._zone for r in ts.source_zones(reports, undeclared, ["UTC", "America/Chicago", "America/New_York"]).collect()}
    assert zones["insurer_c"] == "America/New_York"
    assert zones["insurer_a"] == "UTC"  # no evidence, no declaration
    # Among all known zones, one of the same history.
    found = {r._source: r._zone for r in ts.source_zones(reports, undeclared).collect()}["insurer_c"]
    assert {datetime(2019, m, d, tzinfo=ZoneInfo(found)).utcoffset() == datetime(2019, m, d, tzinfo=ZoneInfo("America/New_York")).utcoffset() for m in range(1, 13) for d in range(1, 29)} == {True}


def test_a_zone_of_half_hours_is_found(spark):
    """No list of usual zones is needed: a source in Kathmandu, of which nothing is declared."""
    from zoneinfo import ZoneInfo

    rows = []
    for i in range(60):
        utc = datetime(2019, 1 + i % 12, 1 + i % 28, 12, i, tzinfo=timezone.utc)
        local = utc.astimezone(ZoneInfo("Asia/Kathmandu")).strftime("%Y-%m-%dT%H:%M:%S")
        rows += [(2 * i, f"e{i}", "insurer_c", None, None, local, datetime(2021, 1, 1)), (2 * i + 1, f"e{i}", "insurer_b", None, utc.strftime("%Y-%m-%dT%H:%M:%SZ"), None, datetime(2021, 1, 1))]
    undeclared = sources(spark).withColumn("local_zone", F.lit(None).cast("string"))
    zones = {r._source: r._zone for r in ts.source_zones(ts.regulatory_reports(spark.createDataFrame(rows, RAW), undeclared), undeclared).collect()}
    assert zones["insurer_c"] in ("Asia/Kathmandu", "Asia/Katmandu")


def test_arrival_rules_out_zones(spark):
    """A report can't arrive before what it reports."""
    rows = [(i, None, "insurer_a", f"2020-05-{1 + i % 28:02d}T10:00:00", None, None, datetime(2020, 5, 1 + i % 28, 13, 0, 1)) for i in range(40)]
    reports = ts.regulatory_reports(spark.createDataFrame(rows, RAW), sources(spark))
    broken = {r._zone: r.violations for r in ts.zone_violations(reports, ["UTC", "America/Sao_Paulo", "America/New_York"]).collect()}
    assert broken == {"UTC": 0, "America/Sao_Paulo": 0}  # New York has 40


def test_empty_unknown_source_and_clashing_columns(spark):
    assert ts.regulatory_occurrences(raw(spark, []), sources(spark)).count() == 0
    df = raw(spark, [("a", "29/03/2018", None)]).withColumn("numeric_date_order", F.lit("x")).withColumn("_source", F.lit("x")).withColumn("date_field", F.lit("x"))
    assert ts.regulatory_occurrences(df, sources(spark)).count() == 1
    assert ts.regulatory_occurrences(df.withColumn("source_system", F.lit("other")), sources(spark)).count() == 0


@pytest.mark.parametrize("text", ["9" * 50, "x" * 100_000, "1.5E99", "9E20", "99/99/9999 99:99", "/Date(9999999999999999)/", "2018-01-01T00:00:00+99:99"])
def test_hopeless_texts_are_unreadable(spark, text):
    assert ts.regulatory_occurrences(raw(spark, [("a", text, None)]), sources(spark)).count() == 0
