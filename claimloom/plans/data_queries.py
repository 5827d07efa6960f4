"""Queries over the data-cleaning operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators import exactly_once as once
from claimloom.operators import history, landing, lateness, schema_drift, table_diff, timestamps
from claimloom.session import read_table, stored

_DAY, _HOUR = 86_400_000_000, 3_600_000_000


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    claims = read_table(spark, d, "bronze_claims").select("record_id", "claim_id", "event_type", "event_timestamp", "_ingested_at")
    return once.redundant_copies(claims).select("record_id")


def p1_kept(spark: SparkSession, d: str) -> DataFrame:
    """The table without copies: rows of even number stand for what is stored, those of odd number for what is new."""
    claims = read_table(spark, d, "bronze_claims")
    halves = F.pmod(F.col("record_id"), F.lit(2)) == 0
    kept = once.exactly_once(claims.filter(halves), claims.filter(~halves))
    return kept.select("record_id", "claim_id", "event_type", "region", F.col("amount").cast("double").alias("amount"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(read_table(spark, d, "regulatory_feed_records"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(read_table(spark, d, "regulatory_feed_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.regulatory_occurrences(read_table(spark, d, "regulatory_claims_raw"), read_table(spark, d, "regulatory_sources"))


def p3_zones(spark: SparkSession, d: str) -> DataFrame:
    """Estimated beside declared zone of each source."""
    raw, sources = read_table(spark, d, "regulatory_claims_raw"), read_table(spark, d, "regulatory_sources")
    zones = timestamps.source_zones(stored(timestamps.regulatory_reports(raw, sources)), sources)
    return zones.select(F.col("_source").alias("source_system"), F.col("_zone").alias("zone"), F.col("_declared").alias("declared_zone"))


#: Instants (hours since 1970) in summer and winter of the years that the test tables cover.
_SEASONS = {"winter_2018": 421_116, "summer_2018": 425_460, "winter_2019": 429_876, "summer_2019": 434_220}


def p3_undeclared(spark: SparkSession, d: str) -> DataFrame:
    """What the reports alone say about the zone of each source, without any declaration: local hours of fixed instants."""
    raw, sources = read_table(spark, d, "regulatory_claims_raw"), read_table(spark, d, "regulatory_sources")
    undeclared = sources.withColumn("local_zone", F.lit(None).cast("string"))
    zones = timestamps.source_zones(stored(timestamps.regulatory_reports(raw, undeclared)), undeclared)
    local = lambda hours: F.hour(F.from_utc_timestamp(F.timestamp_seconds(F.lit(hours * 3600)), F.col("_zone"))).cast("long")
    return zones.select(F.col("_source").alias("source_system"), *[local(h).alias(n) for n, h in _SEASONS.items()])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = history.consent_versions(read_table(spark, d, "consent_events"))
    return found.select(
        F.col("_entity").alias("policy_id"), F.col("_valid_from").alias("valid_from_us"), F.coalesce("_valid_to", F.lit(-1)).alias("valid_to_us")
    )


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    """The full history with its attributes."""
    found = history.consent_versions(read_table(spark, d, "consent_events"))
    return found.select(
        F.col("_entity").alias("policy_id"),
        "consent_status",
        "target_institution",
        F.col("_valid_from").alias("valid_from_us"),
        F.coalesce("_valid_to", F.lit(-1)).alias("valid_to_us"),
        F.col("_valid_to").isNull().alias("is_current"),
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return table_diff.reconciliation_differences(read_table(spark, d, "recon_primary"), read_table(spark, d, "recon_replica"))


def _kept_claims(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    claims = read_table(spark, d, "bronze_claims").select("record_id", "claim_id", "event_type", "event_timestamp", "_ingested_at", *columns)
    return once.exactly_once(claims)


def _event_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of all copies: counting them bounds the kept ones, and reads one column."""
    return read_table(spark, d, "bronze_claims").select("event_timestamp")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lateness.late_rows(_kept_claims(spark, d), sizes=_event_times(spark, d)).select("record_id", F.col("_fate").alias("fate"))


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    totals = lateness.period_totals(_kept_claims(spark, d, "amount"), sizes=_event_times(spark, d))
    money = [F.col(c).cast("double").alias(c) for c in ("published_amount", "final_amount", "dropped_amount")]
    return totals.select(F.col("_period").alias("event_day"), "published_count", "correction_count", "final_count", "dropped_count", *money)


def p6_publications(spark: SparkSession, d: str) -> DataFrame:
    out = lateness.publications(_kept_claims(spark, d, "amount"), sizes=_event_times(spark, d))
    return out.select(F.col("_period").alias("event_day"), "version", "published_us", "row_count", F.col("amount").cast("double").alias("amount"))


def p6_ordered(spark: SparkSession, d: str) -> DataFrame:
    return lateness.released_in_order(_kept_claims(spark, d), sizes=_event_times(spark, d)).withColumnRenamed("_period", "event_day")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return landing.rejected_rows(read_table(spark, d, "claims_landing")).select("line_id", "_reason")


def p7_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = landing.loaded_rows(read_table(spark, d, "claims_landing"))
    return rows.withColumns({"event_timestamp_us": F.unix_micros("event_timestamp"), "amount": F.col("amount").cast("double")}).drop("event_timestamp")


def p7_edits(spark: SparkSession, d: str) -> DataFrame:
    """Failed records with the edits of their cheapest reading."""
    return landing.rejected_rows(read_table(spark, d, "claims_landing"), keep=("line_id", "file_name", "line_no"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_kept, p2_found, p2_table, p3_found, p3_zones, p3_undeclared, p4_found, p4_history, p5_found,
        p6_found, p6_periods, p6_publications, p6_ordered, p7_found, p7_rows, p7_edits,
    )
}

_RANKED = """SELECT *, row_number() OVER (PARTITION BY lower(trim(claim_id)), event_type, event_timestamp
    ORDER BY _ingested_at, record_id) AS copy_no FROM bronze_claims"""
_TIMES = f"""SELECT *, (epoch_us(event_timestamp) // {_DAY} + 1) * {_DAY} AS day_end, epoch_us(_ingested_at) AS came
    FROM ({_RANKED}) WHERE copy_no = 1"""
_FATES = f"""SELECT *, CASE WHEN came > day_end + 72 * {_HOUR} THEN 'dropped' WHEN came > day_end + {_HOUR} THEN 'correction' ELSE 'on_time' END AS fate,
    DATE '1970-01-01' + ((day_end // {_DAY}) - 1)::INT AS event_day FROM ({_TIMES})"""
_EVENTS = """SELECT policy_id, epoch_us(event_timestamp) AS t_us,
    max_by({'s': upper(trim(consent_status)), 'i': upper(trim(target_institution))}, event_no) AS v
  FROM consent_events WHERE consent_status IS NOT NULL AND target_institution IS NOT NULL GROUP BY ALL"""
_VERSIONS = f"""WITH m AS (SELECT *, lag(v) OVER (PARTITION BY policy_id ORDER BY t_us) AS b FROM ({_EVENTS})),
  c AS (SELECT * FROM m WHERE b IS NULL OR b <> v)
  SELECT policy_id, v.s AS consent_status, v.i AS target_institution, t_us AS valid_from_us,
    coalesce(lead(t_us) OVER (PARTITION BY policy_id ORDER BY t_us), -1) AS valid_to_us FROM c"""


def _side(table: str) -> str:
    return f"""SELECT DISTINCT lower(trim(external_reference_id)) AS k, lower(trim(discrepancy_type)) AS t,
      list_sort(list_distinct([lower(trim(x)) FOR x IN sources_reporting])) AS s,
      round(min_amount, 2) AS lo, round(max_amount, 2) AS hi, round(resolved_amount, 2) AS re FROM {table}"""


_FIELDS = {"discrepancy_type": "t", "sources_reporting": "s", "min_amount": "lo", "max_amount": "hi", "resolved_amount": "re"}
_DIFFER = " UNION ALL ".join(
    f"SELECT pk, '{name}' FROM j WHERE pk IS NOT NULL AND rk IS NOT NULL AND p_{c} IS DISTINCT FROM r_{c}" for name, c in _FIELDS.items()
)
_P5 = f"""WITH p AS ({_side("recon_primary")}), r AS ({_side("recon_replica")}),
  j AS (SELECT p.k AS pk, r.k AS rk, {", ".join(f"p.{c} AS p_{c}, r.{c} AS r_{c}" for c in _FIELDS.values())} FROM p FULL JOIN r ON p.k = r.k)
  SELECT rk AS external_reference_id, 'missing_in_primary' AS difference FROM j WHERE pk IS NULL
  UNION ALL SELECT pk, 'missing_in_replica' FROM j WHERE rk IS NULL UNION ALL {_DIFFER}"""

# Cells of JSON objects that nest one level at most, with values as they are written.
_PAIR = """'"((?:[^"\\\\]|\\\\.)*)"\\s*:\\s*("(?:[^"\\\\]|\\\\.)*"|\\{[^{}]*\\}|\\[[^\\[\\]]*\\]|[^",\\s\\[\\]{}]+)'"""
_CELLS = f"""SELECT feed_id, file_no, record_id, unnest(regexp_extract_all(payload, {_PAIR}, 1)) AS field, unnest(regexp_extract_all(payload, {_PAIR}, 2)) AS raw FROM regulatory_feed_records"""
_P2 = f"""WITH cells AS (SELECT feed_id, file_no, record_id, field,
      CASE WHEN raw = 'null' THEN NULL WHEN raw[1] = '"' THEN 'text' WHEN raw[1] = '{{' THEN 'object' WHEN raw[1] = '[' THEN 'array' WHEN raw IN ('true', 'false') THEN 'boolean'
        WHEN contains(raw, '.') THEN 'decimal' ELSE 'integer' END AS kind,
      CASE WHEN raw = 'null' THEN NULL WHEN raw[1] = '"' THEN json_extract_string(raw, '$') WHEN raw[1] IN ('{{', '[') THEN json(raw)::VARCHAR ELSE raw END AS v FROM ({_CELLS})),
  kinds AS (SELECT feed_id, file_no, field, list_sort(list_distinct(list(kind) FILTER (kind IS NOT NULL))) AS k FROM cells GROUP BY ALL),
  heads AS (SELECT feed_id, file_no, field, CASE WHEN coalesce(len(k), 0) = 0 THEN NULL WHEN len(k) = 1 THEN k[1] WHEN k = ['decimal', 'integer'] THEN 'decimal' ELSE 'text' END AS kind FROM kinds),
  files AS (SELECT DISTINCT feed_id, file_no FROM regulatory_feed_records),
  steps AS (SELECT b.feed_id, b.file_no FROM files b JOIN files a ON a.feed_id = b.feed_id AND a.file_no = b.file_no - 1),
  gone AS (SELECT s.feed_id, s.file_no, h.field, h.kind FROM steps s JOIN heads h ON h.feed_id = s.feed_id AND h.file_no = s.file_no - 1
    WHERE NOT EXISTS (FROM heads n WHERE n.feed_id = s.feed_id AND n.file_no = s.file_no AND n.field = h.field)),
  came AS (SELECT s.feed_id, s.file_no, h.field, h.kind FROM steps s JOIN heads h ON h.feed_id = s.feed_id AND h.file_no = s.file_no
    WHERE NOT EXISTS (FROM heads n WHERE n.feed_id = s.feed_id AND n.file_no = s.file_no - 1 AND n.field = h.field)),
  refs AS (SELECT DISTINCT feed_id, file_no, v AS ref, record_id FROM cells WHERE field = 'external_reference_id' AND v IS NOT NULL),
  shared AS (SELECT DISTINCT b.feed_id, b.file_no, b.ref FROM refs b JOIN refs a ON a.feed_id = b.feed_id AND a.file_no = b.file_no - 1 AND a.ref = b.ref),
  vals AS (SELECT r.feed_id, r.file_no, r.ref, c.field, min(c.v) AS v FROM refs r JOIN cells c USING (feed_id, file_no, record_id) GROUP BY ALL),
  tried AS (SELECT s.feed_id, s.file_no, o.field AS old_field, n.field AS new_field, count(*) FILTER (a.v IS DISTINCT FROM b.v) AS unlike, count(*) FILTER (a.v = b.v) AS alike
    FROM shared s JOIN gone o USING (feed_id, file_no) JOIN came n USING (feed_id, file_no)
      LEFT JOIN vals a ON a.feed_id = s.feed_id AND a.file_no = s.file_no - 1 AND a.ref = s.ref AND a.field = o.field
      LEFT JOIN vals b ON b.feed_id = s.feed_id AND b.file_no = s.file_no AND b.ref = s.ref AND b.field = n.field GROUP BY ALL),
  renamed AS (SELECT *, row_number() OVER (PARTITION BY feed_id, file_no, old_field ORDER BY new_field) AS x, row_number() OVER (PARTITION BY feed_id, file_no, new_field ORDER BY old_field) AS y
    FROM tried WHERE unlike = 0 AND alike > 0 QUALIFY x = 1 AND y = 1)
  SELECT feed_id, file_no, 'renamed' AS change, old_field, new_field FROM renamed
  UNION ALL SELECT feed_id, file_no, 'removed', field, '' FROM gone g WHERE NOT EXISTS (FROM renamed r WHERE r.feed_id = g.feed_id AND r.file_no = g.file_no AND r.old_field = g.field)
  UNION ALL SELECT feed_id, file_no, 'added', '', field FROM came c WHERE NOT EXISTS (FROM renamed r WHERE r.feed_id = c.feed_id AND r.file_no = c.file_no AND r.new_field = c.field)
  UNION ALL SELECT r.feed_id, r.file_no, 'retyped', old_field, new_field FROM renamed r JOIN gone g ON g.feed_id = r.feed_id AND g.file_no = r.file_no AND g.field = old_field
    JOIN came c ON c.feed_id = r.feed_id AND c.file_no = r.file_no AND c.field = new_field WHERE g.kind <> c.kind
  UNION ALL SELECT b.feed_id, b.file_no, 'retyped', b.field, b.field FROM heads a JOIN heads b ON a.feed_id = b.feed_id AND a.file_no = b.file_no - 1 AND a.field = b.field WHERE a.kind <> b.kind"""

# Times of loss: the parts of each notation by its own pattern, then civil time to instant by the offsets around it.
_CLOCK = "([0-9]{1,2})[:.H]([0-9]{2})(?:[:.]([0-9]{2})(?:[.,]([0-9]{1,9}))?)?(?: *([AP])[.]?M[.]?)?(?: *(Z|[A-Z]{2,5}|(?:UTC|GMT)?[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2}))?"
_NOTATIONS = {
    "ymd": f"^([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}})(?:[T ]+{_CLOCK})?$",
    "num": f"^([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{4}}|[0-9]{{2}})(?:[T ,]+{_CLOCK})?$",
    "dmy": f"^(?:[\\p{{L}}]{{2,9}}[.]?,? +)?([0-9]{{1,2}}) +(?:DE +)?([\\p{{L}}]{{3,9}})[.]? +(?:DE +)?([0-9]{{4}})(?:[ ,]+{_CLOCK})?$",
    "mdy": f"^(?:[\\p{{L}}]{{2,9}}[.]?,? +)?([\\p{{L}}]{{3,9}})[.]? +([0-9]{{1,2}}),? +([0-9]{{4}})(?:[ ,]+{_CLOCK})?$",
    "dig": "^([0-9]{4})([0-9]{2})([0-9]{2})(?:([0-9]{2})([0-9]{2})([0-9]{2}))?()()()$",
}
_GROUPS = "['a', 'b', 'c', 'h', 'i', 's', 'f', 'p', 'z']"
_PLACES = {"ymd": "abc", "dig": "abc", "dmy": "cba", "mdy": "cab", "num": "cba"}  # year, month, day
_PART_SQL = {k: f"CASE k {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {n}.{k}' for n in _NOTATIONS)} END" for k in "abchisfpz"}
_YMD_SQL = [f"CASE {' '.join(f'WHEN k = {chr(39)}{n}{chr(39)} THEN {n}.{p[i]}' for n, p in _PLACES.items())} END" for i in range(3)]
_MONTHS_SQL = "CASE lower(mo[1:4]) WHEN 'juin' THEN 6 WHEN 'juil' THEN 7 ELSE MAP {" + ", ".join(f"'{k}': {v}" for k, v in timestamps.MONTHS.items()) + "}[lower(mo[1:3])] END"
_ZONES_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in timestamps.ABBREVIATIONS.items()) + "}"
_AHEAD = lambda at: f"(epoch(timezone(local_zone, to_timestamp({at})))::BIGINT - {at})"
_P3 = f"""WITH r AS (SELECT record_id, local_zone, numeric_date_order AS o, CASE date_field WHEN 'data_ocorrencia' THEN data_ocorrencia WHEN 'EVENT_DATE' THEN EVENT_DATE ELSE occurrenceDate END AS stated
    FROM regulatory_claims_raw x JOIN regulatory_sources y ON lower(trim(x.source_system)) = lower(trim(y.source_system))),
  v AS (SELECT *, upper(trim(regexp_replace(stated, '[\\s\u00a0\u202f]+', ' ', 'g'))) AS v FROM r WHERE stated IS NOT NULL),
  m AS (SELECT *, {", ".join(f"regexp_extract(v, '{p}', {_GROUPS}) AS {n}" for n, p in _NOTATIONS.items())},
    CASE WHEN regexp_full_match(v, '[0-9]{{8}}|[0-9]{{14}}') THEN 'dig' WHEN regexp_full_match(v, '[0-9]+') THEN 'count' {" ".join(f"WHEN regexp_matches(v, '{_NOTATIONS[n]}') THEN '{n}'" for n in ("ymd", "num", "dmy", "mdy"))} END AS k FROM v),
  p AS (SELECT record_id, local_zone, v, k, {_YMD_SQL[0]} AS y, CASE WHEN k = 'num' AND upper(trim(o)) = 'MDY' THEN num.a ELSE {_YMD_SQL[1]} END AS mo, CASE WHEN k = 'num' AND upper(trim(o)) = 'MDY' THEN num.b ELSE {_YMD_SQL[2]} END AS d,
    {", ".join(f"nullif({_PART_SQL[c]}, '') AS {c}" for c in "hisfpz")} FROM m),
  n AS (SELECT *, (CASE WHEN len(y) = 2 THEN '20' || y ELSE y END)::INT AS yy, CASE WHEN regexp_full_match(mo, '[0-9]+') THEN mo::INT ELSE {_MONTHS_SQL} END AS mm, d::INT AS dd,
    CASE WHEN p IS NULL THEN coalesce(h::INT, 0) WHEN h::INT BETWEEN 1 AND 12 THEN h::INT % 12 + CASE p WHEN 'P' THEN 12 ELSE 0 END ELSE 99 END AS hh, coalesce(i::INT, 0) AS mi, coalesce(s::INT, 0) AS ss, coalesce(rpad(f, 6, '0')[1:6]::INT, 0) AS us,
    regexp_replace(z, '^(UTC|GMT)([+-])', '\\2') AS zz FROM p WHERE k <> 'count'),
  c AS (SELECT *, epoch(try_cast(printf('%04d-%02d-%02d', yy, mm, dd) AS DATE)::TIMESTAMP)::BIGINT + hh * 3600 + mi * 60 + ss AS u,
    CASE WHEN zz IS NULL THEN NULL WHEN regexp_full_match(zz, '[+-](0[0-9]|1[0-8]):?[0-5][0-9]') THEN zz[1:3] || ':' || zz[-2:] WHEN regexp_full_match(zz, '[+-](0[0-9]|1[0-8])') THEN zz || ':00' ELSE {_ZONES_SQL}[zz] END AS off
    FROM n WHERE hh <= 23 AND mi <= 59 AND ss <= 59),
  w AS (SELECT *, {_AHEAD("(u - 86400)")} AS before, {_AHEAD("(u + 86400)")} AS after FROM c WHERE u IS NOT NULL),
  e AS (SELECT record_id, us, CASE WHEN off IS NOT NULL THEN u - (off[2:3]::INT * 3600 + off[5:6]::INT * 60) * CASE off[1] WHEN '-' THEN -1 ELSE 1 END
      WHEN {_AHEAD("(u - before)")} = before THEN u - before WHEN {_AHEAD("(u - after)")} = after THEN u - after ELSE u - before END AS t FROM w WHERE z IS NULL OR off IS NOT NULL)
  SELECT record_id, t * 1000000 + us AS occurred_us FROM e
  UNION ALL SELECT record_id, CASE len(v) WHEN 10 THEN v::BIGINT * 1000000 WHEN 13 THEN v::BIGINT * 1000 ELSE v::BIGINT END FROM p WHERE k = 'count' AND len(v) IN (10, 13, 16)
  UNION ALL SELECT record_id, floor(v::DECIMAL(38, 6) * 1000)::BIGINT FROM (SELECT record_id, printf('%.6f', try_cast(v AS DOUBLE)) AS v FROM p WHERE k IS NULL AND regexp_full_match(v, '[0-9](\\.[0-9]+)?E\\+?[0-9]{{1,2}}'))
  UNION ALL SELECT record_id, regexp_extract(v, '^/DATE\\((-?[0-9]{{1,16}})([+-][0-9]{{4}})?\\)/$', 1)::BIGINT * 1000 FROM p WHERE k IS NULL AND regexp_matches(v, '^/DATE\\(-?[0-9]{{1,16}}([+-][0-9]{{4}})?\\)/$')"""

# A field is quoted as a whole or not at all; in quotes anything may stand, and a quote is written twice.
_FIELD = '(?:"(?:[^"]|"")*"|[^";]*)'
_P7 = f"""WITH t AS (SELECT line_id, regexp_replace(regexp_replace(raw_value, '^\ufeff', ''), '\r\\z', '') AS t FROM claims_landing),
  q AS (SELECT *, regexp_full_match(t, '(?s){_FIELD}(?:;{_FIELD})*') AS sound, regexp_extract_all(t || ';', '(?s)({_FIELD});', 1) AS cells FROM t),
  f AS (SELECT *, [CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN cells] AS f FROM q),
  r AS (SELECT line_id, CASE WHEN t IS NULL THEN 'column_count' WHEN NOT sound THEN 'broken_quoting' WHEN len(f) <> 10 THEN 'column_count'
      WHEN regexp_full_match(f[1], '(?s)\\s*') OR f[4] NOT IN ('claim-opened', 'claim-updated')
        OR NOT regexp_full_match(f[5], '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])') OR try_cast(substr(f[5], 1, 10) AS DATE) IS NULL
        OR NOT regexp_full_match(f[6], '([0-9]+(\\.[0-9]{{1,2}})?)?') OR f[7] NOT IN ('', 'SP', 'RJ', 'MG', 'BA', 'RS', 'PR', 'SC', 'PE', 'CE', 'GO', 'DF', 'AM') THEN 'invalid_value' END AS _reason, f FROM f)"""
_LOADED = ", ".join(f"nullif(f[{i + 1}], '') AS {c}" for i, c in enumerate(landing.COLUMNS) if c not in ("event_timestamp", "amount"))

ORACLES = {
    "p3_found": _P3,
    "p7_found": f"{_P7} SELECT line_id, _reason FROM r WHERE _reason IS NOT NULL",
    "p7_rows": f"{_P7} SELECT line_id, {_LOADED}, epoch_us(f[5]::TIMESTAMPTZ) AS event_timestamp_us, nullif(f[6], '')::DOUBLE AS amount FROM r WHERE _reason IS NULL",
    "p2_found": _P2,
    "p1_found": f"SELECT record_id FROM ({_RANKED}) WHERE copy_no > 1",
    "p1_kept": f"SELECT record_id, claim_id, event_type, region, amount::DOUBLE AS amount FROM ({_RANKED}) WHERE copy_no = 1",
    "p3_zones": "SELECT source_system, local_zone AS zone, local_zone AS declared_zone FROM regulatory_sources",
    "p3_undeclared": "SELECT source_system, "
    + ", ".join(f"hour(timezone(local_zone, to_timestamp({h * 3600})))::BIGINT AS {n}" for n, h in _SEASONS.items())
    + " FROM regulatory_sources",
    "p4_found": f"SELECT policy_id, valid_from_us, valid_to_us FROM ({_VERSIONS})",
    "p4_history": f"SELECT *, valid_to_us = -1 AS is_current FROM ({_VERSIONS})",
    "p5_found": _P5,
    "p6_found": f"SELECT record_id, fate FROM ({_FATES}) WHERE fate <> 'on_time'",
    "p6_periods": f"""SELECT event_day, count(*) FILTER (fate = 'on_time') AS published_count, count(*) FILTER (fate = 'correction') AS correction_count,
        count(*) FILTER (fate <> 'dropped') AS final_count, count(*) FILTER (fate = 'dropped') AS dropped_count,
        coalesce(sum(amount) FILTER (fate = 'on_time'), 0)::DOUBLE AS published_amount, coalesce(sum(amount) FILTER (fate <> 'dropped'), 0)::DOUBLE AS final_amount,
        coalesce(sum(amount) FILTER (fate = 'dropped'), 0)::DOUBLE AS dropped_amount FROM ({_FATES}) GROUP BY event_day""",
    "p6_publications": f"""WITH s AS (SELECT event_day, day_end, CASE fate WHEN 'on_time' THEN 0 ELSE (came - day_end - {_HOUR} + {_HOUR} - 1) // {_HOUR} END AS step,
          count(*) AS n, coalesce(sum(amount), 0) AS a FROM ({_FATES}) WHERE fate <> 'dropped' GROUP BY ALL)
        SELECT event_day, row_number() OVER (PARTITION BY event_day ORDER BY step) - 1 AS version,
          least(day_end + {_HOUR} + step * {_HOUR}, day_end + 72 * {_HOUR}) AS published_us,
          (sum(n) OVER w)::BIGINT AS row_count, (sum(a) OVER w)::DOUBLE AS amount
        FROM s WINDOW w AS (PARTITION BY event_day ORDER BY step ROWS UNBOUNDED PRECEDING)""",
    "p6_ordered": f"""WITH o AS (SELECT event_day, record_id, epoch_us(event_timestamp) AS t_us, came, epoch_us(event_timestamp) - lag(epoch_us(event_timestamp)) OVER w AS gap,
          (came < lag(came) OVER w)::INT AS inv FROM ({_FATES}) WHERE fate <> 'dropped' WINDOW w AS (PARTITION BY event_day ORDER BY event_timestamp, record_id))
        SELECT event_day, count(*) AS row_count, arg_min(record_id, (t_us, record_id)) AS first_row, arg_max(record_id, (t_us, record_id)) AS last_row,
          coalesce(max(gap), 0) AS longest_gap_us, coalesce(sum(inv), 0)::BIGINT AS inversions FROM o GROUP BY event_day""",
}
