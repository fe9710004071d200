"""Plans of given and derived tables, each built once per call of a query."""

from __future__ import annotations

import functools
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leakscope.sources import tables

_plans: weakref.WeakKeyDictionary[SparkSession, dict] = weakref.WeakKeyDictionary()


def planned_once(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Build the plan of a derived table once per call of a query.

    Naming a table twice in a query then costs no second round of plan building,
    and Spark sees equal subplans. The next call starts anew (:func:`forget`), so
    that a table written on the way never outlives a change of the input.
    """

    @functools.wraps(build)
    def planned(spark: SparkSession, *args: str) -> DataFrame:
        known = _plans.setdefault(spark, {})
        key = (build.__module__, build.__name__, *args)
        if key not in known:
            known[key] = build(spark, *args)
        return known[key]

    return planned


def forget(spark: SparkSession) -> None:
    """Drop the plans of earlier calls; each registered query does so first."""
    _plans.pop(spark, None)


# Tables with long texts and the unique key they are spread by in sessions that ask for it.
SPREAD_BY = {"documents": ("doc_id",), "conversations": ("conv_id", "turn")}


@planned_once
def read_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spread_by = SPREAD_BY.get(name, ()) if spark.conf.get("leakscope.spread", "false") == "true" else ()
    return tables.read_table(spark, sf, name, *spread_by)
