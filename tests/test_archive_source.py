"""One data source over mixed generations of files, against the reader that goes by schema."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stationfill.operators import metadata
from stationfill.sources import archive_source, observations
from tests.test_sources import archive, write  # noqa: F401


def rows(df, names):
    return sorted(map(str, df.select(*names).collect()))


def test_same_rows_as_the_reader_by_schema(spark, archive):  # noqa: F811
    plain = observations.read_observations(spark, f"file:{archive}")
    got = archive_source.read_archive(spark, f"file:{archive}")
    common = ["station_id", "year", "ts", "report_type", "temperature", "temperature_quality_code", "temperature_report_type", "latitude", "longitude", "station_name"]
    assert rows(got, common) == rows(plain, common)
    assert set(plain.columns) <= set(got.columns) and dict(got.dtypes)["temperature"] == "double"
    for years, stations in (([2021], None), (None, ["USW001"]), ([2020, 2021], ["CAX002"]), ([1999], None), ([], None), (None, [])):
        some = archive_source.read_archive(spark, str(archive), years, stations, ["temperature"])
        expected = [r for r in plain.collect() if (years is None or r.year in years) and (stations is None or r.station_id in stations)]
        assert some.count() == len(expected)
        assert "wind_speed" not in some.columns and "temperature_source_code" in some.columns
    mine = rows(metadata.station_metadata(got, computed_at=F.lit(dt.datetime(2026, 1, 1))), metadata.STATION_COLUMNS)
    assert mine == rows(metadata.station_metadata(plain, computed_at=F.lit(dt.datetime(2026, 1, 1))), metadata.STATION_COLUMNS)


def test_one_branch_whatever_the_number_of_schemas(spark, tmp_path):
    for i in range(12):
        write(tmp_path, f"S{i}", 2020, pa.table({"DATE": ["2020-01-01T00:00:00"], f"odd{i}": [i], "temperature": [float(i)] if i % 2 else [f" {i}.5 "]}))
    df = archive_source.read_archive(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Union" not in plan and "GHCNh" not in plan
    assert {r.temperature for r in df.collect()} == {float(i) if i % 2 else i + 0.5 for i in range(12)}
    assert df.select("station_id").distinct().count() == 12


def test_corrupt_files_are_listed_and_other_errors_raised(spark, tmp_path):
    write(tmp_path, "OK1", 2020, pa.table({"DATE": ["2020-01-01T00:00:00"], "temperature": [1.0], "Other": ["x"]}))
    (tmp_path / "2020" / "GHCNh_BAD_2020.parquet").write_bytes(b"not parquet at all")
    (tmp_path / "2020" / "notes.txt").write_text("no report")
    assert archive_source.read_archive(spark, str(tmp_path)).count() == 1
    report = archive_source.file_report(spark, str(tmp_path)).collect()
    bad = [r for r in report if r.error is not None]
    assert [(r.station_id, r.column) for r in bad] == [("BAD", None)] and bad[0].file.endswith("GHCNh_BAD_2020.parquet")
    assert {(r.column, r.type) for r in report if r.error is None} == {("DATE", "string"), ("temperature", "double"), ("Other", "string")}
    assert archive_source.read_archive(spark, str(tmp_path / "2020")).count() == 0  # no folder of a year
    with pytest.raises(Exception, match="gone|No such|not exist|Cannot"):
        archive_source.read_archive(spark, str(tmp_path / "gone")).count()


def test_awkward_columns(spark, tmp_path):
    struct = pa.array([{"a": "t", "b": 4.5}, None], pa.struct([("a", pa.string()), ("b", pa.float64())]))
    codes = pa.array([{"x": "u", "n": 7}, {"x": "v", "n": None}], pa.struct([("x", pa.string()), ("n", pa.int8())]))
    table = {
        "DATE": pa.array([dt.datetime(2020, 1, 1, 2, 3, 4, 567), None], pa.timestamp("us")),
        "Temperature": pa.array([None, 5], pa.int16()),
        "temperature": pa.array(["1e1", "7"], pa.string()),
        "wind_speed": struct,
        "wind_speed_Quality_Code": codes,
        "visibility": pa.nulls(2),
        "precipitation": pa.array(["NaN", ""], pa.string()),
        "station_name": pa.array([["list"], None], pa.list_(pa.string())),
    }
    write(tmp_path, "A", 2020, pa.table(table))
    first, second = archive_source.read_archive(spark, str(tmp_path)).orderBy(F.desc_nulls_last("ts")).collect()
    assert (first.ts, second.ts) == (dt.datetime(2020, 1, 1, 2, 3, 4, 567), None)
    assert (first.temperature, second.temperature) == (10.0, 5.0)
    assert (first.wind_speed, second.wind_speed, first.wind_speed_quality_code, second.wind_speed_quality_code) == (4.5, None, "7", None)
    assert first.visibility is None and first.precipitation is None and first.station_name is None


def test_filters_reach_the_names(spark, archive):  # noqa: F811
    """Pushed filters decide which folders and files are opened; a broken file elsewhere is not touched."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

    def reader():
        return archive_source.PushingReader(archive_source.schema_of(["temperature"]), {"path": str(archive), "shares": "2"})

    one = reader()
    keep = IsNotNull(("temperature",))
    assert list(one.pushFilters([EqualTo(("station_id",), "USW001"), GreaterThanOrEqual(("file_year",), 2021), keep])) == [keep]
    assert {p.folder[-4:] for p in one.partitions()} == {"2021"}
    assert sum(b.num_rows for p in one.partitions() for b in one.read(p)) == 2
    two = reader()
    assert list(two.pushFilters([In(("file_year",), (2019, 2020)), LessThan(("file_year",), 2020)])) == []
    assert two.partitions() == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = archive_source.read_archive(spark, str(archive))
        assert df.where("year = 2020 AND station_id = 'USW001'").count() == 3
        assert df.where("temperature > 5").count() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_written_archives_are_read_back(spark, tmp_path):
    rows = [
        ("A", dt.datetime(2020, 1, 1, 0, 0, 0, 5), "FM-15", 1.5, "1", 40.0),
        ("A", dt.datetime(2021, 5, 1), None, None, None, None),
        ("A", None, "AUTO", 2.0, "3", 41.0),
        ("B", dt.datetime(2020, 2, 1), "FM-12", -1.0, None, None),
        ("B", dt.datetime(2020, 2, 1), "FM-12", -1.0, None, None),
    ]
    reports = spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, report_type string, temperature double, temperature_quality_code string, latitude double")
    for _ in range(2):  # a repeated run writes the same files
        written = archive_source.write_archive(reports, f"file:{tmp_path}/archive").collect()
        assert sorted((r.station_id, r.year, r.n) for r in written) == [("A", 0, 1), ("A", 2020, 1), ("A", 2021, 1), ("B", 2020, 2)]
    back = archive_source.read_archive(spark, f"{tmp_path}/archive").select(*reports.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, reports.collect()))
    plain = observations.read_observations(spark, f"{tmp_path}/archive").select(*reports.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, reports.collect()))
    assert not [p for p in (tmp_path / "archive").rglob("*") if p.is_file() and not p.name.startswith("GHCNh_") and not p.name.endswith(".crc")]
    assert archive_source.write_archive(reports.limit(0), f"{tmp_path}/none").count() == 0
