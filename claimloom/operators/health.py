"""Traffic-light states of pipeline parts, and the graph that shows them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

GREEN, YELLOW, RED, UNKNOWN = "green", "yellow", "red", "unknown"
COLORS = {GREEN: "#2ecc71", YELLOW: "#f1c40f", RED: "#e74c3c", UNKNOWN: "#bdc3c7"}


def freshness(latest: datetime | None, as_of: datetime, most: timedelta = timedelta(minutes=30)) -> str:
    return UNKNOWN if latest is None else GREEN if as_of - latest < most else RED


def compliance(compliant: int, other: int, yellow: float = 0.95, red: float = 0.80) -> str:
    """Green from ``yellow`` on, yellow from ``red`` on."""
    if compliant + other == 0:
        return UNKNOWN
    share = compliant / (compliant + other)
    return GREEN if share >= yellow else YELLOW if share >= red else RED


def compliance_column(compliant: Column, total: Column, yellow: float = 0.95, red: float = 0.80) -> Column:
    share = compliant / F.nullif(total, F.lit(0))
    return F.when(share.isNull(), UNKNOWN).when(share >= yellow, GREEN).when(share >= red, YELLOW).otherwise(RED)


def freshness_column(latest: Column, as_of: datetime, most: timedelta = timedelta(minutes=30)) -> Column:
    return F.when(latest.isNull(), UNKNOWN).when(F.unix_micros(F.lit(as_of)) - F.unix_micros(latest) < F.lit(most // timedelta(microseconds=1)), GREEN).otherwise(RED)


def count_column(count: Column, yellow: int = 1, red: int = 10) -> Column:
    return F.when(count >= red, RED).when(count >= yellow, YELLOW).otherwise(GREEN)


def drift_column(detected: Column) -> Column:
    """Over all rows of drift results."""
    return F.when(F.count(detected) == 0, UNKNOWN).when(F.bool_or(detected), YELLOW).otherwise(GREEN)


def target_column(within: Column) -> Column:
    return F.when(within.isNull(), UNKNOWN).when(within, GREEN).otherwise(RED)


def count_state(count: int, yellow: int = 1, red: int = 10) -> str:
    return RED if count >= red else YELLOW if count >= yellow else GREEN


def drift_state(detected: list[bool]) -> str:
    """Drift alone is never red."""
    return UNKNOWN if not detected else YELLOW if any(detected) else GREEN


def target_state(within: bool | None) -> str:
    return UNKNOWN if within is None else GREEN if within else RED


def table_state(exists: bool) -> str:
    return GREEN if exists else UNKNOWN


def has_sample(measures: dict) -> bool:
    return bool(measures.get("minutes_observed") or measures.get("sample_size"))


def graph_dot(nodes: dict[str, tuple[str, str, list[str]]], states: dict[str, str]) -> str:
    """Graphviz text of ``nodes`` (id to label, cluster and upstream ids), coloured by state."""
    out = ["digraph {", "  rankdir=LR;", "  node [shape=box, style=filled];"]
    for cluster in dict.fromkeys(c for _, c, _ in nodes.values()):
        members = [f'    {k} [label="{label}", fillcolor="{COLORS[states.get(k, UNKNOWN)]}"];' for k, (label, c, _) in nodes.items() if c == cluster]
        out += [f'  subgraph cluster_{cluster} {{ label="{cluster}";', *members, "  }"]
    out += [f"  {up} -> {k};" for k, (_, _, ups) in nodes.items() for up in ups]
    return "\n".join([*out, "}"])


def lineage_dot(edges: list[tuple[str, str]]) -> str:
    return "\n".join(["digraph {", *[f'  "{a}" -> "{b}";' for a, b in edges], "}"])
