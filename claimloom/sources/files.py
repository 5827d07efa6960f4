"""Delimited source files and their normal forms."""

from __future__ import annotations

import logging
import os
import shutil
import tempfile
import threading
import urllib.request
import zipfile
from collections import defaultdict
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.functions import scalar

# Source columns and what they become.
CLAIM_COLUMNS = {"COD_APO": "policy_id", "D_OCORR": "event_timestamp", "INDENIZ": "amount", "REGIAO": "region", "CAUSA": "cause_code"}
POLICY_COLUMNS = {
    "REGISTRO_OPERADORA": "operator_code", "CD_PLANO_RPS": "policy_id", "CD_PLANO_SCPA": "policy_id_legacy", "DT_INCLUSAO": "event_timestamp",
    "ID_MOTIVO_MOVIMENTO": "movement_reason_code", "TP_SEXO": "sex", "SG_UF": "region",
}

_locks: defaultdict[str, threading.Lock] = defaultdict(threading.Lock)


def fetch_csv(url: str, to: str, timeout: float = 60.0) -> str:
    """A file behind ``url`` at ``to``, taken from the first CSV of a zip archive; a file that exists is kept."""
    with _locks[to]:
        if os.path.exists(to):
            return to
        Path(to).parent.mkdir(parents=True, exist_ok=True)
        with tempfile.TemporaryDirectory(dir=Path(to).parent) as work:
            got = Path(work) / "download"
            with urllib.request.urlopen(url, timeout=timeout) as answer, got.open("wb") as out:
                shutil.copyfileobj(answer, out)
            if zipfile.is_zipfile(got):
                with zipfile.ZipFile(got) as archive:
                    names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
                    if not names:
                        raise ValueError("the archive holds no CSV")
                    got = Path(archive.extract(names[0], work))
            os.replace(got, to)
    return to


def read_delimited(spark: SparkSession, path: str, sep: str = ";", encoding: str = "ISO-8859-1", sample_rows: int | None = None, seed: int = 42) -> DataFrame:
    """All columns as text. With ``sample_rows``, a larger file gives that many rows, the same on every run (a sampling
    option of the loaders: rows with the smallest seeded hashes)."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place):
        raise FileNotFoundError(path)
    df = spark.read.csv(path, sep=sep, encoding=encoding, header=True)
    if sample_rows is None:
        return df
    return df.orderBy(F.xxhash64(*df.columns, F.lit(seed))).limit(sample_rows)


def mapped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The mapped columns that are there, renamed; others are left out. Mapped ones that are missing are warned about."""
    missing = [old for old in columns if old not in df.columns]
    if missing:
        logging.getLogger("claimloom").warning("columns missing in the source: %s", ", ".join(missing))
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns.items() if old in df.columns])


def _or_row_id(c: Column, df: DataFrame) -> Column:
    """An id of its own for rows without one, from their content, so that a replay gives the same."""
    return F.coalesce(c.cast("string"), F.sha2(F.to_json(F.struct(*df.columns)), 256))


def claim_events(raw: DataFrame) -> DataFrame:
    df = mapped(raw, CLAIM_COLUMNS)
    return df.select(
        F.sha2(F.to_json(F.struct(*df.columns)), 256).alias("claim_id"),
        _or_row_id(F.col("policy_id"), df).alias("policy_id"),
        F.lit(None).cast("string").alias("customer_id"),
        F.lit("claim-opened").alias("event_type"),
        F.try_to_timestamp(F.col("event_timestamp").cast("string"), F.lit("yyyyMMdd")).alias("event_timestamp"),
        scalar.finite(F.col("amount")).alias("amount"),
        F.col("region").cast("string").alias("region"),
        scalar.decode_cause(F.col("cause_code")).alias("vehicle_type"),
        F.lit("susep").alias("source"),
    )


def policy_events(raw: DataFrame) -> DataFrame:
    df = mapped(raw, POLICY_COLUMNS)
    none = F.lit(None).cast("string")
    column = lambda c: F.col(c) if c in df.columns else none
    plan = column("policy_id") if "policy_id" in df.columns else column("policy_id_legacy")
    return df.select(
        _or_row_id(plan, df).alias("policy_id"),
        none.alias("customer_id"),
        scalar.movement_event(column("movement_reason_code")).alias("event_type"),
        F.try_to_timestamp(F.concat(column("event_timestamp"), F.lit("-01")), F.lit("yyyy-MM-dd")).alias("event_timestamp"),
        F.lit(None).cast("double").alias("premium_amount"),
        none.alias("coverage_type"),
        column("region").alias("region"),
        F.lit("ans").alias("source"),
        *[F.col(c) for c in ("operator_code", "sex") if c in df.columns],
    )


def _draw(salt: str, key: Column) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``salt`` only."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1_000_000)) / 1_000_000.0


def simulated_feed(base: DataFrame, source: str, missing: float = 0.02, apart: float = 0.05, apart_most: float = 0.15, bad_code: float = 0.03, dropped: float = 0.05) -> DataFrame:
    """What one insurer would report of the claims of ``base`` (the claim file's columns), with defects at given rates,
    in the insurer's own layout. Draws depend on claim and source, so a replay gives the same feed."""
    keys = list(CLAIM_COLUMNS)
    known = base.na.drop(subset=keys).withColumn("external_reference_id", scalar.natural_key(*[F.col(k) for k in keys]))
    ref = F.col("external_reference_id")
    draw = lambda what: _draw(f"{source}/{what}", ref)
    rows = known.filter(draw("row") >= missing)
    factor = F.when(draw("amount") < apart, 1 + (draw("by") * 2 - 1) * apart_most).otherwise(1.0)
    lost = F.when(draw("field") < dropped, F.floor(draw("which") * 3)).otherwise(-1)
    keep = lambda i, c: F.when(lost != i, c)
    at = F.try_to_timestamp(F.col("D_OCORR").cast("string"), F.lit("yyyyMMdd"))
    amount = scalar.finite(F.col("INDENIZ")) * factor
    spoiled = draw("code") < bad_code
    cause, region = F.when(spoiled, "99").otherwise(F.col("CAUSA").cast("string")), F.when(spoiled, "ZZ").otherwise(F.col("REGIAO").cast("string"))
    policy, date, money, where, why = {
        "insurer_a": ("numero_apolice", "data_ocorrencia", "valor_indenizacao", "regiao_sinistro", "codigo_causa"),
        "insurer_b": ("POLICY_NUM", "EVENT_DATE", "CLAIM_AMOUNT", "REGION_CODE", "CAUSE_CD"),
        "insurer_c": ("policyId", "occurrenceDate", "amountCents", "regionCode", "causeCode"),
    }[source]
    dates = {"insurer_a": F.date_format(at, "dd/MM/yyyy"), "insurer_b": F.date_format(at, "yyyy-MM-dd"), "insurer_c": F.unix_millis(at).cast("string")}
    amounts = {"insurer_a": scalar.currency_ptbr(amount), "insurer_b": F.format_string("%.2f", amount), "insurer_c": F.round(amount * 100).cast("long").cast("string")}
    return rows.select(
        ref, F.lit(source).alias("source_system"), keep(0, F.col("COD_APO").cast("string")).alias(policy), keep(1, dates[source]).alias(date),
        keep(2, amounts[source]).alias(money), region.alias(where), cause.alias(why),
    )


def simulated_consents(claims: DataFrame, start, share: float = 1.0, revoked: float = 0.2) -> DataFrame:
    """A grant for the drawn share of policies and, for some, a later withdrawal."""
    ids = claims.select("policy_id").filter(F.col("policy_id").isNotNull()).distinct().filter(_draw("chosen", F.col("policy_id")) < share)
    key = F.col("policy_id")
    target = F.element_at(F.array(*[F.lit(f"insurer_{x}") for x in "abc"]), (F.floor(_draw("target", key) * 3) + 1).cast("int"))
    granted = F.unix_seconds(F.lit(start).cast("timestamp")) - F.floor(_draw("age", key) * 10_000) * 60
    events = F.array_compact(
        F.array(
            F.struct(F.lit("GRANTED").alias("consent_status"), granted.alias("s")),
            F.when(_draw("revoked", key) < revoked, F.struct(F.lit("REVOKED").alias("consent_status"), (granted + (1 + F.floor(_draw("after", key) * 1000)) * 60).alias("s"))),
        )
    )
    rows = ids.select("policy_id", target.alias("target_institution"), F.explode(events).alias("e"))
    return rows.select("policy_id", "e.consent_status", "target_institution", F.lit("claims,profile").alias("scope"), F.timestamp_seconds("e.s").alias("event_timestamp"))


LOADERS = {"susep": claim_events, "ans": policy_events}


def replay(spark: SparkSession, sources: dict[str, dict], publish_to) -> int:
    """Loads each enabled source (``loader``, ``path``, ``topic``) and hands it to ``publish_to(df, topic)``. Unknown
    loaders are passed over with a warning; none at all raises."""
    done = 0
    for name, spec in sources.items():
        if not spec.get("enabled", True):
            continue
        if spec["loader"] not in LOADERS:
            logging.getLogger("claimloom").warning("source %s: no loader %s", name, spec["loader"])
            continue
        publish_to(LOADERS[spec["loader"]](read_delimited(spark, spec["path"], sample_rows=spec.get("sample_rows"))), spec["topic"])
        done += 1
    if not done:
        raise RuntimeError("no source to replay")
    return done
