"""Messages delivered more than once: keep one copy of each.

Frequencies are counted on a 64-bit digest of the identifier, so that the counting shuffle carries sixteen bytes a
group after map-side combining. A digest that occurs once proves that its row has no copy, and that row passes
directly. Rows of repeated digests are ranked on the full identifier, which also undoes digest collisions.

Groups larger than ``hot_rows`` are recognised by a broadcast list, before any join on the digest, and ranked in two
rounds: inside salted parts whose number follows the group's frequency, then among the winners of the parts. The list
holds the ``HOT_GROUPS`` most frequent digests at most. Of N rows, a group that isn't on it has no more than
``hot_rows`` or N / ``HOT_GROUPS`` of them, so no task ever holds a hot group.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.session import free_prefix

#: Rows of one identifier that a single task may rank.
HOT_ROWS = 200_000
#: Identifiers on the broadcast list of hot groups; each takes a few bytes.
HOT_GROUPS = 100_000


@dataclass(frozen=True)
class MessageKey:
    """What identifies a message and which copy comes first.

    ``identifier`` lists normalised expressions. Rows whose first expression is null or empty carry no identifier, can't
    be recognised as copies and all stay. The other parts compare null-safe.
    ``order`` lists expressions; the smallest row is kept. Nulls come last. It should end with a unique column.
    """

    identifier: Sequence[Column]
    order: Sequence[Column]


def claim_message_key() -> MessageKey:
    """Copies of claim messages agree in claim_id (case and blanks aside), event_type and event_timestamp."""
    return MessageKey(
        [F.lower(F.trim("claim_id")), F.col("event_type"), F.col("event_timestamp")],
        [F.col("_ingested_at"), F.col("record_id")],
    )


@dataclass
class Split:
    """The four disjoint parts of the input."""

    anonymous: DataFrame  # without identifier
    singletons: DataFrame  # identifier that occurs once
    kept: DataFrame  # first copy of each repeated message
    redundant: DataFrame  # every other copy


def split_by_frequency(df: DataFrame, key: MessageKey, hot_rows: int = HOT_ROWS) -> Split:
    """Split the rows of ``df`` by how often their identifier occurs, and rank only the repeated ones.

    Working columns take a prefix that no input column has, so extra columns of any name pass through.
    """
    columns, w = [F.col(f"`{c}`") for c in df.columns], free_prefix(df)
    ids, orders = [f"{w}id{i}" for i in range(len(key.identifier))], [f"{w}order{i}" for i in range(len(key.order))]
    digest, copies, parts, part, rank = (w + x for x in ("digest", "copies", "parts", "part", "rank"))
    identified = key.identifier[0].isNotNull()
    if isinstance(df.select(key.identifier[0]).schema[0].dataType, T.StringType):
        identified = identified & (key.identifier[0] != "")
    known = df.filter(identified).withColumn(digest, F.xxhash64(*key.identifier))
    anonymous = df.filter(~identified).select(columns)
    # Identifier and order are worked out behind the joins: single and repeated rows then share one shuffle.
    keyed = lambda rows: rows.withColumns(dict(zip(ids, key.identifier)) | dict(zip(orders, key.order)))

    repeated = known.groupBy(digest).agg(F.count(F.lit(1)).alias(copies)).filter(F.col(copies) > 1)
    hot = repeated.filter(F.col(copies) > hot_rows).orderBy(F.col(copies).desc(), digest).limit(HOT_GROUPS)
    hot = F.broadcast(hot.select(digest, F.ceil(F.col(copies) / hot_rows).cast("int").alias(parts)))
    cold = known.join(hot, digest, "left_anti")
    singletons = cold.join(repeated, digest, "left_anti").select(columns)

    first_copy, whole = [F.col(c).asc_nulls_last() for c in orders], Window.partitionBy(digest, *ids)
    ranked = keyed(cold.join(repeated, digest, "left_semi")).withColumn(rank, F.row_number().over(whole.orderBy(*first_copy)))
    salted = keyed(known.join(hot, digest)).withColumn(part, F.pmod(F.xxhash64(*orders), F.col(parts)))
    rounds = salted.withColumn(rank, F.row_number().over(Window.partitionBy(digest, *ids, part).orderBy(*first_copy)))
    first = F.col(rank) == 1
    finalists = rounds.filter(first).withColumn(rank, F.row_number().over(whole.orderBy(*first_copy)))
    kept = ranked.filter(first).select(columns).union(finalists.filter(first).select(columns))
    redundant = ranked.filter(~first).select(columns).union(rounds.filter(~first).select(columns)).union(finalists.filter(~first).select(columns))
    return Split(anonymous, singletons, kept, redundant)


def exactly_once(stored: DataFrame, new: DataFrame | None = None, key: MessageKey | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One copy of every message among all stored and new rows.

    Empty inputs give an empty result. Rows without identifier all stay. Fully equal rows count as copies and one
    stays. Columns beyond the key pass through unchanged; columns that only one side has are null on the other.
    """
    rows = stored if new is None else stored.unionByName(new, allowMissingColumns=True)
    parts = split_by_frequency(rows, key or claim_message_key(), hot_rows)
    return parts.anonymous.union(parts.singletons).union(parts.kept)


def redundant_copies(df: DataFrame, key: MessageKey | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every row that ``exactly_once`` leaves out."""
    return split_by_frequency(df, key or claim_message_key(), hot_rows).redundant
