"""Checks of physical plans, for tests and for users who want to see what will run."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Operators that no native query should need.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "SinglePartition")


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def unwanted(df: DataFrame, allowed: tuple[str, ...] = ()) -> list[str]:
    """Unwanted operators of the plan."""
    plan = physical_plan(df)
    return [u for u in UNWANTED if u in plan and u not in allowed]


def pushed_filters(df: DataFrame) -> list[str]:
    """What the scans say about filters and columns."""
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().treeString(True, True, 2000, False).splitlines() if "PushedFilters" in line or "ReadSchema" in line]
