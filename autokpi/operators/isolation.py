"""Independent results that must not end each other (L1, L3; D26).

Spark plans are lazy: a bad cast or a missing column shows up in the action.
So every branch runs its own action inside its own ``try``, a few at a time,
and comes back as a value: its rows or its stored frame, the metrics observed
on the way, or the class of the error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession

from autokpi.session import ensure_checkpoint_dir

#: Branches whose jobs are submitted side by side.
AT_ONCE = 4
#: Without this rule an empty stage keeps its node of observed metrics.
_EMPTY_RULE = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


@dataclass
class Outcome:
    rows: list[Row] = field(default_factory=list)
    frame: DataFrame | None = None
    seen: dict = field(default_factory=dict)
    error: str | None = None


def _named(exc: Exception) -> str:
    condition = exc.getCondition() if isinstance(exc, PySparkException) else None
    return condition or type(exc).__name__


def _attempt(plan: Callable[[Observation], DataFrame], act: Callable[[DataFrame], dict]) -> Outcome:
    seen = Observation()
    try:
        done = Outcome(**act(plan(seen)))
    except Exception as exc:  # noqa: BLE001 -- a branch that fails is a result
        return Outcome(error=_named(exc))
    done.seen = seen.get
    return done


def collected(plan: Callable[[Observation], DataFrame]) -> Outcome:
    """Run a branch whose result is a few rows."""
    return _attempt(plan, lambda df: {"rows": df.collect()})


def stored(plan: Callable[[Observation], DataFrame]) -> Outcome:
    """Run a branch and keep its result as a reliable checkpoint."""
    def act(df: DataFrame) -> dict:
        ensure_checkpoint_dir(df.sparkSession)
        return {"frame": df.checkpoint(eager=True)}
    return _attempt(plan, act)


def in_turn(spark: SparkSession, run: Callable, items: Iterable) -> list:
    """``run`` for every item, ``AT_ONCE`` at a time, results in order; observed metrics survive empty stages."""
    key = "spark.sql.adaptive.optimizer.excludedRules"
    old = spark.conf.get(key, None)
    spark.conf.set(key, ",".join(filter(None, [old, _EMPTY_RULE])))
    try:
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return list(pool.map(run, items))
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
