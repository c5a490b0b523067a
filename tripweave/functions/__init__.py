"""Column expressions of the telemetry domain (all JVM-side, no Python UDF)."""

from tripweave.functions.numbers import (  # noqa: F401
    finite_or_null, fixed, nonzero, py_round, ratio, settled, swap_correct,
)
from tripweave.functions.text import (  # noqa: F401
    local_start_of_file, noise, number_text, parse_seconds, sensor_group, short_name, slugify,
    start_of_trip_id, strip_zone, trip_id_of_file, vin_suffix,
)
from tripweave.functions.times import (  # noqa: F401
    add_seconds, day_month, dst_seconds, epoch_seconds, end_time, local_to_utc, seconds_between,
    whole_seconds,
)
from tripweave.functions.trip_columns import (  # noqa: F401
    average_speed, color_ramp, km_per_l, l_per_100, km_per_l_of_trip, sources_of, trip_cost,
)
