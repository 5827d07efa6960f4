"""History of changing entity attributes: gaps and islands over all events or snapshots.

Within an entity, ordered by time, a row whose attribute hash differs from the row before marks a change; the running
sum of the marks numbers the islands; the first time of an island and the start of the next give the validity.

An entity may hold most of the rows. All rows are brought into the order of entity and time by one range partitioning,
which cuts them into chunks of even size wherever an entity begins or ends. Chunks are processed apart. At each border at
most one entity goes on, so one row per chunk carries the state that a chunk is entered with, and the first change that
comes after it, across the borders. No task holds a whole hot entity, and no join meets in one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.session import stored


def normalised(name: str) -> Column:
    """Letter case and surrounding blanks don't count."""
    return F.upper(F.trim(F.col(name)))


def _places(attributes) -> list[str]:
    """Working names of the attributes, by place: their own names may be any."""
    return [f"_a{i}" for i in range(len(attributes))]


def latest_event_per_instant(df: DataFrame, entity: str, at: str, event_no: str, attributes: dict[str, Column]) -> DataFrame:
    """One row per entity and instant: rows without entity, time or any attribute don't count; of an instant's
    events the one with the largest number counts (a null number is smallest). Repeated messages of one event agree
    in the normalised attributes; should they not, the greatest values win, so the result never depends on order.
    """
    names = _places(attributes)
    kept = df.select(F.col(entity).alias("_entity"), F.unix_micros(F.col(at)).alias("_at"), F.col(event_no).alias("_no"), *[c.alias(n) for n, c in zip(names, attributes.values())])
    kept = kept.filter(F.col("_entity").isNotNull() & F.col("_at").isNotNull()).na.drop(subset=names)
    last = F.max(F.struct(F.coalesce(F.col("_no"), F.lit(-(2**63))).alias("no"), *names)).alias("_last")
    return kept.groupBy("_entity", "_at").agg(last).select("_entity", "_at", *[F.col(f"_last.{n}").alias(n) for n in names])


def _in_chunks(rows: DataFrame, chunks: int | None) -> DataFrame:
    """Adds ``_chunk``, the number of the range of entities and times in which a row lies. Stored, since another run of the
    range partitioning might draw other borders."""
    ranged = rows.repartitionByRange("_entity", "_at") if chunks is None else rows.repartitionByRange(chunks, "_entity", "_at")
    return stored(ranged.withColumn("_chunk", F.spark_partition_id()))


def _differs(state: Column, before: Column, names: Sequence[str]) -> Column:
    """Hashes tell most changes; values are compared where hashes are equal."""
    return (state["h"] != before["h"]) | F.exists(F.array(*[~state[n].eqNullSafe(before[n]) for n in names]), lambda x: x)


def versions(rows: DataFrame, attributes: Sequence[str], chunks: int | None = None) -> DataFrame:
    """Versions of ``rows`` (``_entity``, ``_at`` in microseconds, ``_a0``, ``_a1``, ... for the attributes; one row per
    entity and instant). ``chunks`` is the number of ranges, which otherwise follows the session and the size of the data.

    Returns ``_entity``, ``_valid_from``, ``_valid_to`` (null for the last version), the attributes and ``_events``
    (rows in the version that lie in the chunk in which it starts). Null attributes equal only null.
    """
    given, names = list(attributes), _places(attributes)
    state = F.struct(F.xxhash64(*names).alias("h"), *names)
    chunked = _in_chunks(rows, chunks).withColumn("_state", state)
    # One row a chunk: the number of chunks bounds all that is ordered in one task and broadcast here.
    borders = chunked.groupBy("_chunk").agg(F.min(F.struct("_entity", "_at")).alias("_first"), F.max(F.struct("_entity", "_at", "_state")).alias("_last"))
    by_chunk = Window.orderBy("_chunk")
    borders = borders.withColumns({"_left": F.lag("_last").over(by_chunk), "_earlier": F.lag("_chunk").over(by_chunk)})
    spans = borders.filter(F.col("_left._entity") == F.col("_first._entity")).select("_chunk", F.col("_first._entity").alias("_entity"), F.col("_left._state").alias("_entered"), "_earlier")
    entered = F.broadcast(spans.select("_chunk", "_entity", "_entered"))

    inside = Window.partitionBy("_chunk", "_entity").orderBy("_at")
    marked = chunked.withColumn("_before", F.lag("_state").over(inside)).join(entered, ["_chunk", "_entity"], "left")
    before = F.coalesce(F.col("_before"), F.col("_entered"))
    changed = before.isNull() | _differs(F.col("_state"), before, names)
    islands = (
        marked.withColumn("_change", changed.cast("long"))
        .withColumn("_island", F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("_island") > 0)
        .groupBy("_chunk", "_entity", "_island")
        .agg(F.min(F.struct("_at", *names)).alias("_first"), F.count(F.lit(1)).alias("_events"))
        .select("_chunk", "_entity", F.col("_first._at").alias("_valid_from"), *[F.col(f"_first.{n}").alias(n) for n in names], "_events")
    )
    # The start of the next island: inside the chunk, else the first change of a later chunk, which is the first row there
    # that differs from the state that the chunk is entered with.
    firsts = chunked.join(entered, ["_chunk", "_entity"]).filter(_differs(F.col("_state"), F.col("_entered"), names)).groupBy("_chunk", "_entity").agg(F.min("_at").alias("_change_at"))
    nearest = Window.partitionBy("_entity").orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = (
        spans.join(firsts, ["_chunk", "_entity"], "left")
        .withColumn("_next_change", F.last("_change_at", ignorenulls=True).over(nearest))
        .select(F.col("_earlier").alias("_chunk"), "_entity", "_next_change")
    )
    following = F.lead("_valid_from").over(Window.partitionBy("_chunk", "_entity").orderBy("_valid_from"))
    return (
        islands.withColumn("_following", following)
        .join(F.broadcast(later), ["_chunk", "_entity"], "left")
        .select("_entity", "_valid_from", F.coalesce("_following", "_next_change").alias("_valid_to"), *[F.col(n).alias(g) for g, n in zip(given, names)], "_events")
    )


def consent_versions(events: DataFrame, chunks: int | None = None) -> DataFrame:
    """Periods of consent_status and target_institution per policy. ``scope`` is not tracked."""
    attributes = {"consent_status": normalised("consent_status"), "target_institution": normalised("target_institution")}
    return versions(latest_event_per_instant(events, "policy_id", "event_timestamp", "event_no", attributes), list(attributes), chunks)


def snapshot_versions(snapshots: DataFrame, entity: str, taken_at: str, attributes: Sequence[str], chunks: int | None = None) -> DataFrame:
    """Versions from periodic snapshots: ``taken_at`` is the instant of the snapshot. Attributes may be null."""
    names = _places(attributes)
    one = (
        snapshots.select(F.col(entity).alias("_entity"), F.unix_micros(F.col(taken_at)).alias("_at"), *[F.col(f"`{a}`").alias(n) for a, n in zip(attributes, names)])
        .filter(F.col("_entity").isNotNull() & F.col("_at").isNotNull())
        .groupBy("_entity", "_at")
        .agg(F.max(F.struct(*names)).alias("_s"))
        .select("_entity", "_at", *[F.col(f"_s.{n}").alias(n) for n in names])
    )
    return versions(one, attributes, chunks)
