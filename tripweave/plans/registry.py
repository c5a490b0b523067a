"""Named queries over the driver tables, each with its oracle SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from tripweave.functions import py_round
from tripweave.plans.views import dec, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), recursive: bool = False):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, *views, recursive=recursive)
        return fn

    return register


# means and ratios: nine decimals, as a mean of 2^k decimals often ends on a tie at six
_RATIOS = {"recent", "older", "median", "mean", "mean_before", "last_rate", "slope", "mean_cost", "avg_price",
           "cost_per_100km", "mean_distance_km", "km_per_l", "avg_fuel_price", "avg_speed_kmh", "avg_rpm",
           "price_fuel"}


def _digits(name: str) -> int:
    return 9 if name in _RATIOS else 6


def r6(c, name: str | None = None, inline: bool = False) -> Column:
    """Computed doubles are compared to six decimals, means and ratios to nine."""
    name = name or (c if isinstance(c, str) else "value")
    return py_round(c, _digits(name), inline=inline).alias(name)


def s6(x: str, name: str | None = None) -> str:
    return f"{dec(x, _digits(name or x))} AS {name or x}"
