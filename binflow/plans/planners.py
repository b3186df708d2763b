"""Registry of redistribution planners over overload cost curves.

A planner takes `sites` (site_id, group_key, latitude, longitude, max_containers), their
`curves` (site_id, now, costs) and a configuration, and returns single-container moves or
None. It plans every compatibility group in one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binflow.operators.readings import least_full_first
from binflow.plans import overload
from binflow.plans.overload import OverloadConfig
from binflow.session import cut

Planner = Callable[[DataFrame, DataFrame, OverloadConfig], DataFrame | None]

PLANNERS: dict[str, Planner] = {"overload": overload.greedy_moves}


def register(key: str, planner: Planner) -> None:
    PLANNERS[key] = planner


def planner(key: str) -> Planner:
    if key not in PLANNERS:
        raise KeyError(f"unknown planner: {key}")
    return PLANNERS[key]


def build_plan(
    sites: DataFrame, containers: DataFrame, readings: DataFrame, clock, config: OverloadConfig, key: str = "overload", capacity: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame] | None:
    """(moves with containers and levels, one-row summary), or None without any move.

    From readings to plan: candidates and hourly series, accumulated waste, cost curves,
    moves, concrete containers.
    """
    candidates, hourly = overload.candidates(sites, containers, readings, clock, config, capacity)
    candidates = cut(candidates)
    acc = cut(overload.accumulated(hourly, candidates.select("site_id", "containers")))
    moves = planner(key)(candidates, cut(overload.cost_curves(acc)), config)
    if moves is None:
        return None
    order = ["round", F.col("overload_reduction").desc(), "distance_km"]
    placed = overload.assign_containers(overload.cumulative_levels(moves, candidates, order), least_full_first(containers))
    return overload.merge_groups(placed), overload.plan_summary(moves, candidates, overload.overload_steps(acc))
