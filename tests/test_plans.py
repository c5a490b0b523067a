"""How many exchanges the plans of the ordered operators have: rows meet once, the rest are summaries."""

import re

import pytest

from tripweave.plans import QUERIES

FOLDER = "/root/testdata/sf0.001"
#: the most exchanges, those that are read a second time not counted
MOST = {"pid_segments": 16, "dpf_state": 8, "pid_at_gps": 12, "gps_dedup": 6, "obd_chains": 4, "run_length_below": 2,
        "economy_stats": 6, "trend_series": 5, "downsample_n": 4}


def exchanges(df) -> int:
    return len(re.findall(r"(?m)^[\s:+*()\d-]*Exchange ", df._jdf.queryExecution().executedPlan().toString()))


@pytest.fixture(scope="module")
def static(spark):
    """Plans as planned: nothing is changed at run time or broadcast."""
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    for c, v in kept.items():
        spark.conf.set(c, v)


@pytest.mark.parametrize("name", sorted(MOST))
def test_exchanges(static, name):
    assert exchanges(QUERIES[name](static, FOLDER)) <= MOST[name]
