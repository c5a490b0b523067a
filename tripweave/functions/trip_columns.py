"""Derived trip columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripweave import fixed_values as fv
from tripweave.functions.numbers import col, nonzero, py_round, ratio


def average_speed(distance_km, seconds) -> Column:
    return F.when(col(seconds) > 0, ratio(distance_km, col(seconds) / 3600.0))


def l_per_100(fuel_l, distance_km) -> Column:
    ok = (col(distance_km) > 0) & (col(fuel_l) > 0)
    return F.when(ok, ratio(fuel_l, distance_km) * 100.0)


def km_per_l(distance_km, fuel_l) -> Column:
    return F.when((col(distance_km) > 0) & (col(fuel_l) > 0), ratio(distance_km, fuel_l))


def trip_cost(fuel_l, price) -> Column:
    return nonzero(fuel_l) * nonzero(price)


def km_per_l_of_trip(kml="kml", l100="l100km", distance="distance_km", fuel="fuel_l") -> Column:
    """Stored economy, else from litres per 100 km, else from distance and fuel."""
    from_l100 = F.when(col(l100) > 0, py_round(ratio(F.lit(100.0), l100), 2))
    from_fuel = F.when(col(fuel) > 0, py_round(ratio(nonzero(distance), fuel), 2))
    return F.coalesce(nonzero(kml), from_l100, from_fuel)


def sources_of(source="source", cloud_id="cloud_id") -> Column:
    """Which feeds a stored trip came from."""
    sensor = col(source).isin(fv.SENSOR_STORED, fv.SENSOR_BINARY_STORED)
    both = F.array_compact(F.array(
        F.when(sensor, F.lit(fv.SENSOR_SOURCE)),
        F.when(col(cloud_id).isNotNull(), F.lit(fv.CLOUD_SOURCE))))
    fallback = F.when(col(source) == fv.CLOUD_STORED, F.lit(fv.CLOUD_SOURCE)).otherwise(
        F.lit(fv.SENSOR_SOURCE))
    return F.when(F.size(both) > 0, both).otherwise(F.array(fallback))


def color_ramp(norm, stops=((215, 25, 28), (255, 255, 191), (26, 150, 65))) -> Column:
    """Hex colour of a value in [0, 1] by linear blending between colour stops."""
    n = F.least(F.greatest(col(norm), F.lit(0.0)), F.lit(1.0))
    spans = len(stops) - 1
    parts = []
    for channel in range(3):
        value = None
        for i in range(spans):
            a, b = stops[i][channel], stops[i + 1][channel]
            blend = F.lit(float(a)) + (n * spans - float(i)) * float(b - a)
            if i == spans - 1:
                value = blend if value is None else value.otherwise(blend)
            else:
                inside = n * spans <= float(i + 1)
                value = F.when(inside, blend) if value is None else value.when(inside, blend)
        parts.append(F.lpad(F.lower(F.hex(F.floor(value + 0.5).cast("bigint"))), 2, "0"))
    return F.concat(F.lit("#"), *parts)
