"""How much of a graph a request may read: limits from a budget of work units (driver side)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds and defaults of a request, and by action the cost of a node and an edge and the edges
# expected for a node.
UNITS, MOST_UNITS, DEADLINE_MS, MOST_DEADLINE_MS = 20_000, 100_000, 5_000, 30_000
COSTS = {"cycles": (3, 1, 2), "audit:gaps": (4, 1, 2), "audit:smells": (5, 2, 3), "audit:hotspots": (4, 2, 3)}
OTHER = (3, 1, 2)


@dataclass(frozen=True)
class WorkPlan:
    action: str
    max_work_units: int
    deadline_ms: int
    node_limit: int
    edge_limit: int
    planned_work_units: int


def bounded(value: float | None, default: int, most: int) -> int:
    """A whole number from 1 to ``most``; the default for anything that is no finite number."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        return default
    return max(1, min(most, math.floor(value)))


def work_plan(action: str, max_work_units: float | None = None, deadline_ms: float | None = None) -> WorkPlan:
    """As many nodes, each with the edges expected for it, as the units pay for."""
    node, edge, fan = COSTS.get(action, OTHER)
    units = bounded(max_work_units, UNITS, MOST_UNITS)
    nodes = units // (node + edge * fan)
    return WorkPlan(action, units, bounded(deadline_ms, DEADLINE_MS, MOST_DEADLINE_MS), nodes, nodes * fan, nodes * (node + edge * fan))


def work_limits(action: Column, units: Column) -> list[Column]:
    """``work_plan`` of columns: units, node_limit, edge_limit, planned."""
    cost = lambda k: F.coalesce(*[F.when(action == name, c[k]) for name, c in COSTS.items()], F.lit(OTHER[k])).cast("long")
    node, edge, fan = map(cost, range(3))
    bound = F.least(F.lit(MOST_UNITS), F.greatest(F.lit(1), F.coalesce(units, F.lit(UNITS)))).cast("long")
    nodes = F.floor(bound / (node + edge * fan)).cast("long")
    return [bound.alias("units"), nodes.alias("node_limit"), (nodes * fan).alias("edge_limit"), (nodes * (node + edge * fan)).alias("planned")]
