"""Consent views and synthetic profiles."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.session import salted_join
from claimloom.store import scd2_merged

# The name lists of the synthetic profiles.
FIRST = ["Ana", "Bruno", "Carla", "Diego", "Elisa", "Fábio", "Gabriela", "Heitor"]
LAST = ["Silva", "Souza", "Costa", "Oliveira", "Pereira", "Santos", "Almeida"]
AGES = (18, 80)


def current_consents(history: DataFrame) -> DataFrame:
    return history.filter("is_current").select("policy_id", "consent_status", "target_institution", "scope", "valid_from")


def shareable(consents: DataFrame, profiles: DataFrame, claims: DataFrame) -> DataFrame:
    """Granted consents with their profile and claims; consents without claim stay, those without profile don't.

    One policy may have most of the claims, so claims are spread over parts of the join, and consents without any are
    added apart.
    """
    granted = consents.filter(F.col("consent_status") == "GRANTED").select("policy_id", "target_institution", "scope")
    shared = granted.join(profiles.select("policy_id", "synthetic_name", "synthetic_age", "risk_score"), "policy_id")
    told = claims.select("policy_id", "claim_id", "event_type", "amount", "region")
    columns = [*shared.columns, *told.columns[1:]]
    met = salted_join(told, shared.withColumn("_granted", F.lit(True)), "policy_id", F.struct(*told.columns)).filter("_granted").select(*columns)
    alone = shared.join(told.select("policy_id").distinct(), "policy_id", "left_anti")
    return met.unionByName(alone, allowMissingColumns=True)


def profile(policy_id: str) -> tuple[str, int, float]:
    """Name, age and risk drawn from a generator seeded with the id's SHA-256, modulo 2^32."""
    draw = random.Random(int(hashlib.sha256(policy_id.encode()).hexdigest(), 16) % 2**32)
    first, last = draw.choice(FIRST), draw.choice(LAST)
    return f"{first} {last}", draw.randint(*AGES), round(draw.uniform(0.0, 1.0), 4)


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        drawn = [profile(p) for p in batch["policy_id"]]
        yield pd.DataFrame({"policy_id": batch["policy_id"], **{n: [d[i] for d in drawn] for i, n in enumerate(("synthetic_name", "synthetic_age", "risk_score"))}})


def profiles(claims: DataFrame) -> DataFrame:
    """One profile per policy. The generator has no counterpart in SQL, so distinct ids go through Arrow batches."""
    ids = claims.select("policy_id").filter(F.col("policy_id").isNotNull()).distinct()
    return ids.mapInPandas(_profiles, "policy_id string, synthetic_name string, synthetic_age long, risk_score double")


def consent_history(events: DataFrame, batches: DataFrame | None = None) -> DataFrame:
    """History after merging ``events`` and then, if given, a later batch."""
    first = scd2_merged(None, events, "policy_id", "event_timestamp")
    return first if batches is None else scd2_merged(first, batches, "policy_id", "event_timestamp")


def by_institution(consents: DataFrame) -> DataFrame:
    return consents.groupBy("target_institution", "consent_status").agg(F.count(F.lit(1)).alias("total"))
