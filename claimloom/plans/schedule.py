"""Steps that run at intervals and after one another."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta
from graphlib import TopologicalSorter

# How often each job runs.
INTERVALS = {
    "bronze": timedelta(minutes=5),
    "silver": timedelta(minutes=5),
    "score": timedelta(minutes=5),
    "regulatory_bronze": timedelta(minutes=10),
    "gold_aggregate": timedelta(minutes=10),
    "latency": timedelta(minutes=15),
    "consent_bronze": timedelta(minutes=15),
    "regulatory": timedelta(minutes=30),
    "open_insurance": timedelta(minutes=30),
    "drift": timedelta(hours=6),
    "train": timedelta(hours=6),
}


@dataclass(frozen=True)
class Step:
    """``run`` is called every ``every``, after the steps named in ``after``; without interval whenever one of them ran."""

    run: Callable[[], object]
    every: timedelta | None = None
    after: tuple[str, ...] = ()


def order_of(steps: dict[str, Step]) -> list[str]:
    """Steps in an order in which each comes after those it depends on; unknown ones and circles raise."""
    unknown = {a for s in steps.values() for a in s.after} - steps.keys()
    if unknown:
        raise ValueError(f"no steps {sorted(unknown)}")
    return [*TopologicalSorter({n: s.after for n, s in steps.items()}).static_order()]


class Schedule:
    """Runs due steps in order. Whoever calls ``tick`` decides when; a step that was missed runs once."""

    def __init__(self, steps: dict[str, Step]):
        self.steps, self.order = steps, order_of(steps)
        self.last: dict[str, datetime] = {}

    def due(self, name: str, now: datetime, ran: dict[str, bool]) -> bool:
        step = self.steps[name]
        if any(ran.get(a) is False for a in step.after):
            return False
        if step.every is None:
            return any(ran.get(a) for a in step.after) or not step.after
        return name not in self.last or now - self.last[name] >= step.every

    def tick(self, now: datetime) -> dict[str, bool]:
        """Whether each step that was due ended well. What depends on a step that failed doesn't run."""
        ran: dict[str, bool] = {}
        for name in self.order:
            if any(ran.get(a) is False for a in self.steps[name].after):
                ran[name] = False
            elif self.due(name, now, ran):
                self.last[name] = now
                try:
                    self.steps[name].run()
                    ran[name] = True
                except Exception:
                    logging.getLogger("claimloom").exception("step %s failed", name)
                    ran[name] = False
        return ran
