"""Filter states, one small series per state and guard."""

import pytest

from tripweave.operators.dpf import DESIGN_VARIANT, DpfRules, dpf_state

R = DpfRules()


def state(spark, series, rules=R):
    data, seq = [], 0
    for role, values in series.items():
        for x in values:
            data.append((1, seq, float(seq), R.sensors[role], float(x)))
            seq += 1
    rows = spark.createDataFrame(data, "trip_id long, seq long, sec double, pid string, value double")
    r = dpf_state(rows, rules, chunk_rows=2).collect()[0]
    return r.dpf_state, r.dpf_regen_active


HOT = {"egt_after": [551]}
CASES = [
    ({"status": [0, 0, 0]}, ("idle", 0)),
    ({"status": [1, 1]}, ("idle", 0)),                                     # two samples are noise
    ({"status": [1, 0, 1, 0, 1]}, ("requested", 0)),                       # three, not consecutive
    ({"status": [1, 1, 1], **HOT}, ("active", 1)),
    ({"status": [1, 1, 1], "enable": [0, 0], **HOT}, ("idle", 0)),         # not enabled
    ({"status": [1, 1, 1], "outlet": [501]}, ("active", 1)),
    ({"status": [1, 1, 1], "soot": [6, 0.5], **HOT}, ("completed", 1)),
    ({"status": [1, 1, 1], "distance": [300, 299, 5, 5, 5], **HOT}, ("completed", 1)),
    ({"status": [1, 1, 1], "distance": [300, 5, 5, 299, 5], **HOT}, ("active", 1)),   # run broken
    ({"status": [1, 1, 1], "distance": [300, 5, 5], **HOT}, ("active", 1)),           # too few
    ({"status": [1, 1, 1], "distance": [20, 1, 1, 1], **HOT}, ("active", 1)),         # starts too low
    ({"status": [0], "distance": [50, 19]}, ("post_regen", 0)),
    ({"status": [0], "distance": [0.5, 30], **HOT}, ("post_regen", 0)),    # cooling down
    ({"status": [0], "distance": [0.5, 30]}, ("idle", 0)),
]


@pytest.mark.parametrize("series,want", CASES)
def test_states(spark, series, want):
    assert state(spark, series) == want


def test_design_variant(spark):
    assert state(spark, {"status": [1], **HOT, "distance": [300, 5]}, DESIGN_VARIANT) == ("completed", 1)
    assert state(spark, {"status": [1], "outlet": [900]}, DESIGN_VARIANT) == ("requested", 0)
