"""Sensor logs: narrow delimited text, one file per driving session.

Six positional columns: seconds, sensor, value, unit, latitude, longitude.  The
header line and a trailing delimiter are ignored.  A row order number is taken
from the file position, so "first" and "last" mean file order everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave import fixed_values as fv
from tripweave.functions import (local_start_of_file, local_to_utc, number_text, parse_seconds,
                                 trip_id_of_file)
from tripweave.functions.text import stripped

DELIMITERS = [";", ",", "\t"]
_FIELDS = ["c0", "c1", "c2", "c3", "c4", "c5"]
_SCHEMA = ", ".join(f"{c} string" for c in _FIELDS)
_ROW_BITS = 33


def file_order(block_start="_block", row_id="_row") -> Column:
    """Unique, increasing order number of a row inside its file.

    High bits: 64 KiB block the split starts in; low bits: row number inside the
    read task.  Needs no sort, no shuffle and no line counting.
    """
    block = F.shiftright(F.col(block_start).cast("bigint"), 16)
    low = F.col(row_id).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return F.shiftleft(block, _ROW_BITS).bitwiseOR(low)


def read_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(path, seq, line) of every file, header line dropped, byte-order mark removed."""
    raw = (spark.read.schema("line string").option("header", True).option("sep", "\u0001")
           .option("quote", "").option("pathGlobFilter", glob)
           .option("recursiveFileLookup", True).csv(path))
    return with_file_order(raw.select("line", *file_position()))


def file_position() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]


def with_file_order(raw: DataFrame) -> DataFrame:
    """Decoded path and row order in place of the raw file position."""
    kept = [c for c in raw.columns if c not in ("_file", "_block")]
    return (raw.withColumn("_row", F.monotonically_increasing_id())
            .select(F.url_decode("_file").alias("path"), file_order().alias("seq"), *kept))


def base_name(path="path") -> Column:
    return F.element_at(F.split(path, "/"), -1)


def vehicle_folder(path="path") -> Column:
    """The folder a log lies in, for trees with one folder per vehicle."""
    return F.element_at(F.split(path, "/"), -2)


def split_line(line: str, delimiter: str) -> Column:
    return F.from_csv(F.col(line), F.lit(_SCHEMA), {"sep": delimiter, "mode": "PERMISSIVE"})


def sample_columns(row: str) -> list[Column]:
    """Typed sample columns of a struct of six strings (null where not valid)."""
    def f(c):
        return F.col(f"{row}.{c}") if row else F.col(c)

    lat, lon = number_text(f("c4")), number_text(f("c5"))
    blank = lambda c: F.coalesce(stripped(f(c)), F.lit("")) == ""
    bad = (~blank("c4") & lat.isNull()) | (~blank("c5") & lon.isNull())
    place = lambda v: F.when(bad, 0.0).otherwise(F.coalesce(v, F.lit(0.0)))
    return [parse_seconds(f("c0")).alias("sec"),
            F.coalesce(stripped(f("c1")), F.lit("")).alias("pid"),
            number_text(f("c2")).alias("value"),
            F.coalesce(stripped(f("c3")), F.lit("")).alias("unit"),
            place(lat).alias("lat"), place(lon).alias("lon")]


def valid_row() -> Column:
    return F.col("sec").isNotNull() & F.col("value").isNotNull()


def reject_reason(row: str = "r") -> Column:
    return (F.when(F.col(f"{row}.c2").isNull(), "too few fields")
            .when(F.col("sec").isNull(), "bad time").when(F.col("value").isNull(), "bad value"))


def parse_lines(lines: DataFrame, delimiter: str = ";") -> DataFrame:
    """Every line with its typed columns and the reason it is rejected, if any."""
    return _typed(lines, split_line("line", delimiter), lines.columns)


def _typed(lines: DataFrame, fields: Column, kept: list[str]) -> DataFrame:
    """Typed columns over the split line.

    The one-element explode keeps later filters above the split; pushed below it,
    they would split the same line once per field they look at.
    """
    return (lines.select(*kept, F.explode(F.array(fields)).alias("r"))
            .select(*kept, "r", *sample_columns("r"))
            .withColumn("reason", reject_reason()).drop("r"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(valid_row()).drop("reason", "line")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~valid_row()).select(
        *[c for c in parsed.columns if c in ("path", "filename", "seq", "line", "reason")])


def sniff_delimiters(lines: DataFrame, key: str = "path") -> DataFrame:
    """(file, delimiter): the first of the three with a valid row, per file."""
    tests = []
    for i, d in enumerate(DELIMITERS):
        r = split_line("line", d)
        ok = parse_seconds(r["c0"]).isNotNull() & number_text(r["c2"]).isNotNull()
        tests.append(F.max(ok).alias(f"ok{i}"))
    flags = lines.groupBy(key).agg(*tests)
    pick = F.coalesce(*[F.when(F.col(f"ok{i}"), F.lit(d)) for i, d in enumerate(DELIMITERS)])
    return flags.select(key, pick.alias("delimiter"))


def parse_sniffed(lines: DataFrame, delimiters: DataFrame, key: str = "path") -> DataFrame:
    """Parse each line with its file's delimiter."""
    rows = lines.join(delimiters, key)
    r = None
    for d in DELIMITERS:
        hit = F.col("delimiter") == d
        r = F.when(hit, split_line("line", d)) if r is None else r.when(hit, split_line("line", d))
    return _typed(rows, r, lines.columns)


def scan_samples(spark: SparkSession, path: str, delimiter: str | None = ";",
                 vehicle: Column | None = None, glob: str = "*.csv") -> DataFrame:
    """The samples table of a folder of sensor logs.

    With a known delimiter the text is parsed by the CSV reader directly; without
    one, each file's delimiter is found first.  Logs do not name their vehicle:
    pass a column over ``path`` (such as ``vehicle_folder()``), which then also
    becomes part of the trip id.
    """
    if delimiter is None:
        lines = read_lines(spark, path, glob)
        rows = accepted(parse_sniffed(lines, sniff_delimiters(lines)))
    else:
        raw = (spark.read.schema(_SCHEMA).option("header", True).option("sep", delimiter)
               .option("pathGlobFilter", glob).option("recursiveFileLookup", True).csv(path))
        raw = with_file_order(raw.select("*", *file_position()))
        rows = raw.select("path", "seq", *sample_columns("")).filter(valid_row())
    return rows.select(*trip_columns(vehicle), "seq", "sec", "pid", "value", "unit", "lat", "lon")


def trip_columns(vehicle: Column | None = None) -> list[Column]:
    """vehicle_id, trip_id, path and filename of a log from its ``path``."""
    trip = trip_id_of_file("path")
    if vehicle is None:
        vehicle = F.lit("default")
    else:
        trip = F.concat(vehicle, F.lit("/"), trip)
    return [vehicle.alias("vehicle_id"), trip.alias("trip_id"), F.col("path"), base_name().alias("filename")]


def list_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """File names and sizes only; the content column is pruned and never read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob)
            .option("recursiveFileLookup", True).load(path)
            .select(F.url_decode("_metadata.file_path").alias("path"), "length")
            .withColumn("filename", base_name()))


def empty_files(files: DataFrame, samples: DataFrame, key: str = "path") -> DataFrame:
    """Files without one valid row."""
    return files.join(samples.select(key).distinct(), key, "left_anti")


def file_table(samples: DataFrame) -> DataFrame:
    """One row per trip: vehicle, file name, local and UTC start."""
    files = samples.groupBy("trip_id").agg(F.min("vehicle_id").alias("vehicle_id"),
                                           F.min("filename").alias("filename"))
    start = local_start_of_file("filename")
    return files.select("trip_id", "vehicle_id", "filename", start.alias("start"),
                        local_to_utc(start, fv.LOCAL_ZONE).alias("start_utc"))
