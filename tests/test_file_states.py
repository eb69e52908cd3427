"""States per file: equal to the whole computation, and only changed files are read."""

import datetime as dt
import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stationfill.operators import day_states, metadata
from stationfill.plans import file_states
from stationfill.sources import observations

AT = dt.datetime(2026, 1, 1)


def write(root, station, year, seed, n=60):
    """A file with copies of instants, reports without a time, summaries, unknown types and missing values."""
    draw = random.Random(seed)
    begin = dt.datetime(year, 1, 1)
    times = sorted(begin + dt.timedelta(minutes=30 * draw.randrange(400)) for _ in range(n))
    table = {
        "DATE": [t.isoformat() if draw.random() > 0.05 else None for t in times],
        "Station_name": [draw.choice(["Old name", None]) if t.day < 4 else "New name" for t in times],
        "LATITUDE": [draw.choice([None, 40.0 + seed]) for _ in times],
        "LONGITUDE": [-90.0 - draw.randrange(3) for _ in times],
        "temperature": [draw.choice([None, round(draw.gauss(10, 5), 2)]) for _ in times],
        "temperature_Quality_Code": [draw.choice(["1", "3", None]) for _ in times],
        "temperature_Report_Type": [draw.choice(["FM-15", "FM-12", "AUTO", None, "odd"]) for _ in times],
        "sea_level_pressure": [draw.choice([None, 1000.0 + draw.random()]) for _ in times],
    }
    folder = root / str(year)
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table(table, schema=pa.schema([(c, pa.float64() if c in ("LATITUDE", "LONGITUDE", "temperature", "sea_level_pressure") else pa.string()) for c in table])), folder / f"GHCNh_{station}_{year}.parquet")


@pytest.fixture
def archive(tmp_path):
    for i, station in enumerate(("USA", "CAB", "MXC")):
        for year in (2019, 2020, 2021):
            write(tmp_path / "raw", station, year, 10 * i + year % 10)
    return tmp_path / "raw"


def rows(table):
    """Comparable rows; sums of doubles may differ in their last digits."""
    def plain(x):
        if isinstance(x, float):
            return round(x, 9)
        if isinstance(x, dict):
            return tuple(sorted((k, plain(v)) for k, v in x.items()))
        if isinstance(x, tuple) and hasattr(x, "asDict"):
            return plain(x.asDict())
        return tuple(map(plain, x)) if isinstance(x, list) else x

    return {r["station_id"]: plain(r) for r in table.collect()}


def read_files(df):
    """Names of the observation files that a plan reads."""
    return {os.path.basename(f) for f in df.inputFiles() if "GHCNh_" in f}


def whole(spark, archive):
    return metadata.station_metadata(observations.read_observations(spark, str(archive)), computed_at=F.lit(AT))


def test_states_equal_the_whole_through_changes(spark, archive, tmp_path, monkeypatch):
    states, seen = f"{tmp_path}/states", []
    read = observations.read_observations

    def watched(*args, **kwargs):
        out = read(*args, **kwargs)
        seen.append(read_files(out))
        return out

    monkeypatch.setattr(observations, "read_observations", watched)

    def update():
        seen.clear()
        got = rows(file_states.station_table(spark, str(archive), states, computed_at=F.lit(AT)))
        touched = set().union(*seen)
        assert got == rows(whole(spark, archive))
        return touched

    assert len(update()) == 9
    assert update() == set()  # nothing has changed, no file is read
    write(archive, "USA", 2020, 77, n=80)
    write(archive, "NEW", 2021, 78)
    assert update() == {"GHCNh_USA_2020.parquet", "GHCNh_NEW_2021.parquet"}
    (archive / "2019" / "GHCNh_CAB_2019.parquet").unlink()
    assert update() == set()
    write(archive, "MXC", 2021, 79, n=0)  # a file without reports
    assert update() == {"GHCNh_MXC_2021.parquet"}
    assert update() == set()
    file_states.compact(spark, str(archive), states, f"{states}-small")
    assert rows(file_states.station_table(spark, str(archive), f"{states}-small", computed_at=F.lit(AT))) == rows(whole(spark, archive))
    assert spark.read.parquet(f"{states}-small").count() < spark.read.parquet(states).count()


def test_a_run_that_is_repeated_counts_once(spark, archive, tmp_path):
    states = f"{tmp_path}/states"
    file_states.add_states(spark, str(archive), states)
    again = spark.read.parquet(states).withColumn("run", F.lit("~later"))
    again.write.mode("append").parquet(states)
    got = file_states.station_table(spark, str(archive), states, computed_at=F.lit(AT))
    assert rows(got) == rows(whole(spark, archive))


def test_parts_of_a_day_merge(spark):
    """Halves of the reports, dealt by chance so that days, instants and types are in both."""
    draw = random.Random(5)
    begin = dt.datetime(2020, 12, 30)
    data = [
        (draw.choice("ab"), begin + dt.timedelta(seconds=20 * draw.randrange(30_000)) if draw.random() > 0.05 else None, draw.choice(["FM-15", "FM-12", None]), draw.choice([None, draw.gauss(0, 9)]), draw.choice("xyz"))
        for _ in range(400)
    ]
    reports = spark.createDataFrame(data, "station_id string, ts timestamp_ntz, report_type string, temperature double, part string")
    merged = metadata.metadata_of_states(day_states.merge_parts(day_states.day_states(reports, part="part")), F.lit(AT))
    assert rows(merged) == rows(metadata.station_metadata(reports, computed_at=F.lit(AT)))
    assert rows(merged)["a"][1:] and metadata.station_metadata(reports.limit(0)).count() == 0


def test_gaps_agree_with_the_gap_analysis(spark):
    draw = random.Random(6)
    begin = dt.datetime(2020, 1, 1)
    data = [(draw.choice("abcd"), begin + dt.timedelta(seconds=draw.randrange(20_000_000)), "AUTO") for _ in range(500)]
    reports = spark.createDataFrame(data + [("e", begin, None), ("f", None, None)], "station_id string, ts timestamp_ntz, report_type string")
    totals = day_states.station_totals(day_states.day_states(reports))
    names = ["station_id", "gap_count_24h", "max_gap_hours", "avg_interval_hours", "expected_observations"]
    assert rows(totals.select(*names)) == rows(metadata.gap_analysis(reports).select(*names))


def test_one_scan_and_one_shuffle_of_instants(spark, tmp_path):
    draw = random.Random(7)
    data = [(f"s{draw.randrange(4)}", dt.datetime(2020, 1, 1) + dt.timedelta(hours=draw.randrange(9000)), "AUTO", 1.0) for _ in range(300)]
    spark.createDataFrame(data, "station_id string, ts timestamp_ntz, report_type string, temperature double").write.parquet(f"{tmp_path}/r")
    plan = metadata.station_metadata(spark.read.parquet(f"{tmp_path}/r"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    # Days by station and day, combined before; then days by station without their instants.
    assert plan.count("Exchange hashpartitioning") == 2


def test_an_incremental_station_table_opens_stale_files_only(spark, archive, tmp_path, monkeypatch):
    from stationfill.plans import station_table

    station_table.compute(spark, str(archive), f"{tmp_path}/table", clean=False, computed_at=F.current_timestamp())
    seen, read = [], observations.read_observations

    def watched(*args, **kwargs):
        out = read(*args, **kwargs)
        seen.append(read_files(out))
        return out

    monkeypatch.setattr(observations, "read_observations", watched)
    same = station_table.compute(spark, str(archive), f"{tmp_path}/table", incremental=True)
    assert seen == [] and same.count() == 3
    write(archive, "CAB", 2020, 91, n=75)
    later = dt.datetime.now() + dt.timedelta(days=2)
    os.utime(archive / "2020" / "GHCNh_CAB_2020.parquet", (later.timestamp(), later.timestamp()))
    got = station_table.compute(spark, str(archive), f"{tmp_path}/table-updated", incremental=True, computed_at=F.lit(AT))
    assert [sorted(x) for x in seen] == [[f"GHCNh_CAB_{y}.parquet" for y in (2019, 2020, 2021)]]
    assert rows(got.where("station_id = 'CAB'")) == {"CAB": rows(whole(spark, archive))["CAB"]}
    assert got.count() == 3
