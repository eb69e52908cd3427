import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from stationfill.operators import metadata, reports
from stationfill.plans import preprocess, station_table
from stationfill.sources import inventory, manifest, observations, tables


def write(root, station, year, table):
    folder = root / str(year)
    folder.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, folder / f"GHCNh_{station}_{year}.parquet")


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    """Three generations of files: numbers; texts and struct codes; date parts."""
    root = tmp_path_factory.mktemp("raw")
    write(
        root,
        "USW001",
        2020,
        pa.table(
            {
                "STATION": ["USW001"] * 3,
                "Station_name": ["A"] * 3,
                "DATE": ["2020-01-01T00:00:00", "2020-01-01T01:00:00", "broken"],
                "LATITUDE": [40.0, 40.0, 40.0],
                "LONGITUDE": [-90.0, -90.0, -90.0],
                "temperature": [1.0, 2.0, None],
                "temperature_Quality_Code": pa.array([1, 3, None], pa.int32()),
                "temperature_Report_Type_Code": ["FM-15", "FM-12", None],
            }
        ),
    )
    write(
        root,
        "USW001",
        2021,
        pa.table(
            {
                "STATION": ["USW001"] * 2,
                "Station_name": ["A"] * 2,
                "DATE": ["2021-01-01T00:00:00", "2021-01-03T00:00:00"],
                "Latitude": ["40.0", "n/a"],
                "Longitude": ["-90.0", "-90.0"],
                "temperature": ["5.5", "bad"],
                "temperature_Quality_Code": pa.array(
                    [{"member0": 7, "member1": "x"}, {"member0": None, "member1": "y"}],
                    pa.struct([("member1", pa.string()), ("member0", pa.int32())]),
                ),
                "temperature_Report_Type": ["AUTO", "FM-15"],
            }
        ),
    )
    write(
        root,
        "CAX002",
        2021,
        pa.table(
            {
                "STATION": ["CAX002"],
                "Year": [2021],
                "Month": [6],
                "Day": [2],
                "Hour": [3],
                "Minute": [30],
                "temperature": [9.0],
                "temperature_Quality_Code": ["A"],
                "temperature_Report_Type": ["FM12-SYNOP"],
            }
        ),
    )
    return root


def test_parsing():
    assert observations.parse_years("2010,2012:2015, x,1:2:3") == [2010, 2012, 2013, 2014, 2015]
    assert observations.parse_years(None) is None
    assert observations.parse_stations(" usw1, caX ,") == ["USW1", "CAX"]


def test_listing_and_footers(spark, archive):
    files = observations.list_files(spark, f"file:{archive}")
    assert {(r.station_id, r.year) for r in files.collect()} == {("USW001", 2020), ("USW001", 2021), ("CAX002", 2021)}
    assert observations.list_files(spark, f"file:{archive}", [2020, 1999]).count() == 1
    assert {r.station_id for r in observations.list_stations(files).collect()} == {"USW001", "CAX002"}
    assert {r.year for r in observations.list_years(files, "CAX002").collect()} == {2021}
    columns = {r.column: r.type for r in observations.available_columns(files, "CAX002", 2021).collect()}
    assert columns["Year"] == "int64" and "DATE" not in columns
    totals = {r.year: r.n_files for r in manifest.file_totals(files).collect()}
    assert totals == {2020: 1, 2021: 2}


def test_mixed_generations_become_one_table(spark, archive):
    rows = observations.read_observations(spark, f"file:{archive}")
    assert dict(rows.dtypes)["temperature"] == "double"
    assert dict(rows.dtypes)["temperature_quality_code"] == "string"
    got = {(r.station_id, r.ts, r.temperature, r.temperature_quality_code, r.report_type) for r in rows.collect()}
    assert got == {
        ("USW001", dt.datetime(2020, 1, 1, 0), 1.0, "1", "FM-15"),
        ("USW001", dt.datetime(2020, 1, 1, 1), 2.0, "3", "FM-12"),
        ("USW001", None, None, None, None),
        ("USW001", dt.datetime(2021, 1, 1), 5.5, "7", "AUTO"),
        ("USW001", dt.datetime(2021, 1, 3), None, None, "FM-15"),
        ("CAX002", dt.datetime(2021, 6, 2, 3, 30), 9.0, "A", "FM12-SYNOP"),
    }
    one = observations.read_observations(spark, f"file:{archive}", years=[2021], stations=["USW001"])
    assert one.count() == 2
    ids = spark.createDataFrame([("CAX002",)], "station_id string")
    assert observations.read_observations(spark, f"file:{archive}", stations=ids).count() == 1


def test_unreadable_file_is_left_out(spark, tmp_path):
    write(tmp_path, "US1", 2020, pa.table({"DATE": ["2020-01-01T00:00:00"], "temperature": [1.0]}))
    (tmp_path / "2020" / "GHCNh_US2_2020.parquet").write_bytes(b"not parquet")
    assert observations.read_observations(spark, f"file:{tmp_path}").count() == 1


def test_unreadable_files_are_named_and_other_errors_raised(spark, tmp_path):
    write(tmp_path, "OK1", 2020, pa.table({"DATE": ["2020-01-01T00:00:00"], "temperature": [1.0]}))
    (tmp_path / "2020" / "GHCNh_BAD_2020.parquet").write_bytes(b"not parquet at all")
    files = observations.list_files(spark, str(tmp_path))
    bad = observations.unreadable_files(files).collect()
    assert len(bad) == 1 and bad[0].file.endswith("GHCNh_BAD_2020.parquet") and bad[0].error
    gone = files.withColumn("file", F.concat("file", F.lit(".gone")))
    with pytest.raises(Exception, match="gone|No such file"):
        observations.schema_census(gone).count()


def test_station_table_plan(spark, archive, tmp_path):
    whole = station_table.compute(spark, str(archive), f"{tmp_path}/stations", clean=False)
    assert whole.count() == observations.list_stations(observations.list_files(spark, str(archive))).count()
    again = station_table.compute(spark, str(archive), f"{tmp_path}/stations", incremental=True)
    assert sorted(r.station_id for r in again.collect()) == sorted(r.station_id for r in whole.collect())
    one = station_table.compute(spark, str(archive), f"{tmp_path}/one", only="usw001", years="2020:2021", clean=False)
    assert [r.station_id for r in one.collect()] == ["USW001"]


def test_archive_to_station_table_and_back(spark, archive, tmp_path):
    rows = observations.read_observations(spark, f"file:{archive}")
    stations = metadata.station_metadata(rows)
    got = {r.station_id: r for r in stations.collect()}
    us, ca = got["USW001"], got["CAX002"]
    assert us.total_records_all_types == 5 and us.records_excluded_by_filter == 1 and us.total_observation_count == 4
    assert us.report_type_counts == {"FM-15": 2, "FM-12": 1, "AUTO": 1, "null": 1}
    assert us.temperature_completeness_pct == pytest.approx(25.0)
    assert us.years_available == [2020, 2021] and us.latitude == 40.0 and us.station_name == "A"
    assert us.gap_count_24h == 2
    assert ca.total_observation_count == 0 and ca.first_observation is None and ca.temperature_completeness_pct == 0.0
    assert ca.year_counts == {} and ca.max_gap_duration_hours is None

    tables.save_stations(stations, f"{tmp_path}/meta", f"{tmp_path}/csv")
    loaded, other = tables.load_stations(spark, f"{tmp_path}/meta")
    assert loaded.columns == list(stations.columns) and other.count() == 0
    text = spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').where("station_id = 'CAX002'").first()
    assert '"min":null' in text.temperature_stats


def test_selection_round_trip(spark, tmp_path):
    picked = spark.createDataFrame([("A", [1, 2]), ("B", [])], "station_id string, years_available array<int>")
    tables.export_selection(picked, f"{tmp_path}/csv", f"{tmp_path}/ids")
    assert {r.station_id for r in tables.read_selection(spark, f"{tmp_path}/ids").collect()} == {"A", "B"}
    (tmp_path / "list.json").write_text('[\n "C",\n "D"\n]')
    (tmp_path / "named.json").write_text('{"stations": ["E"]}')
    assert {r.station_id for r in tables.read_selection(spark, f"{tmp_path}/list.json").collect()} == {"C", "D"}
    assert {r.station_id for r in tables.read_selection(spark, f"{tmp_path}/named.json").collect()} == {"E"}


def test_preprocess_writes_one_folder_per_split(spark, archive, tmp_path):
    rows = observations.read_observations(spark, f"file:{archive}")
    stations = metadata.station_metadata(rows)
    prepared = preprocess.prepare(rows, stations, stations, "simulated", ["temperature"], normalization="zscore")
    preprocess.write_splits(prepared, f"{tmp_path}/out")
    train = preprocess.read_split(spark, f"{tmp_path}/out", "train")
    got = {(r.ts, r.temperature, r.latitude, r.normalization) for r in train.collect()}
    assert (dt.datetime(2020, 1, 1), 1.0, 40.0, "zscore") in got
    assert (dt.datetime(2021, 1, 1), None, 40.0, "zscore") in got  # code 7 blanks the value
    assert train.count() == 4


def test_inventory_csv_and_countries(spark, tmp_path):
    (tmp_path / "list.csv").write_text("GHCN_ID,LATITUDE,LONGITUDE,ELEVATION,STATE,NAME,WMO_ID,ICAO\nUS1,1.5,x,10, TX ,Town,NA,\nFR1,2,3,4,N/A,Ville,007,LF\n")
    got = {r.station_id: r for r in inventory.read_inventory(spark, str(tmp_path / "list.csv")).collect()}
    assert got["US1"].latitude == 1.5 and got["US1"].longitude is None and got["US1"].state == "TX"
    assert got["US1"].wmo_id is None and got["US1"].icao_code is None
    assert got["FR1"].state is None and got["FR1"].wmo_id == "007"
    (tmp_path / "countries.txt").write_text("FIPS ID     COUNTRY NAME\n\nFR          FRANCE       \nUS          UNITED STATES\n")
    countries = inventory.read_countries(spark, str(tmp_path / "countries.txt"))
    ids = spark.createDataFrame([("US1",), ("US2",), ("FR1",), ("X",)], "station_id string")
    report = inventory.country_report(ids, countries).collect()
    assert [(r.country_code, r.n_stations, r.north_america, r.country_name) for r in report] == [
        ("US", 2, True, "UNITED STATES"),
        ("FR", 1, False, "FRANCE"),
    ]


def test_results_formats(spark, tmp_path):
    metrics = spark.createDataFrame([("overall", "all", None)], "stratification string, stratum string, rmse double")
    tables.save_results(metrics, f"{tmp_path}/j", "json")
    tables.save_results(metrics, f"{tmp_path}/p", "parquet")
    assert "rmse" in spark.read.json(f"{tmp_path}/j").columns and spark.read.parquet(f"{tmp_path}/p").count() == 1
    with pytest.raises(ValueError):
        tables.save_results(metrics, f"{tmp_path}/x", "xml")


def test_variable_selection_and_missing_columns(spark):
    df = spark.createDataFrame([("s", 1.0, "1", 5.0)], "station string, temperature double, temperature_quality_code string, other double")
    assert reports.select_variables(df, ["temperature"]).columns == ["station", "temperature", "temperature_quality_code"]
    assert reports.keep_by_quality(df, "absent").count() == 1
    assert reports.keep_by_quality(df, "absent", valid=False).count() == 0
    assert reports.keep_hourly(df).count() == 1
    assert reports.blank_flagged_values(df, ["temperature"], erroneous=False) is not None
    codes = spark.createDataFrame([("1",), (None,), ("3",)], "temperature_quality_code string").withColumn("temperature", F.lit(1.0))
    kept = reports.blank_flagged_values(codes).select("temperature").collect()
    assert [r.temperature for r in kept] == [1.0, 1.0, None]


def test_summary_types_by_prefix_and_null(spark):
    df = spark.createDataFrame([("FM-12",), ("FM-12x",), ("AUTO",), (None,), ("new",)], "report_type string")
    assert {r.report_type for r in reports.keep_hourly(df).collect()} == {"AUTO", None, "new"}


def test_year_and_station_filters_reach_the_files(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 5 station_id", "timestamp_ntz '2019-06-01 00:00:00' + make_dt_interval(cast(id * 10 as int)) ts")
    rows.write.parquet(f"{tmp_path}/reports")
    df = spark.read.parquet(f"{tmp_path}/reports")
    kept = df.where(observations.in_years([2020, 2021])).where(observations.of_stations(df, ["3", "x"]))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ts,2020-01-01" in pushed and "LessThan(ts,2022" in pushed and "IsNotNull(station_id)" in pushed
    assert kept.count() == rows.where("year(ts) in (2020, 2021) and station_id = 3").count() > 0


def test_gap_analysis_reads_once_and_shuffles_instants_once(spark, tmp_path):
    rows = spark.range(100).selectExpr("id % 5 station_id", "timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(0, cast(id as int)) ts")
    rows.unionByName(rows.limit(7).withColumn("ts", F.lit(None).cast("timestamp_ntz"))).write.parquet(f"{tmp_path}/reports")
    gaps = metadata.gap_analysis(spark.read.parquet(f"{tmp_path}/reports"))
    plan = gaps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2  # instants by day, days by station
    assert sum(r.total_observations for r in gaps.collect()) == 107


def jobs_of(spark, work):
    """The tasks of every job's stages that ``work`` runs."""
    spark.sparkContext.setJobGroup(f"watched-{id(work)}", "")
    try:
        work()
        tracker = spark.sparkContext.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"watched-{id(work)}")]
        stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
        return [s.numTasks for s in stages if s is not None]
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_files_are_listed_by_shares_of_a_folder(spark, tmp_path):
    """Neither the listing nor a choice among the files of a folder takes a task a file."""
    for i in range(90):
        write(tmp_path, f"S{i}", 2020, pa.table({"DATE": ["2020-01-01T00:00:00"], "temperature": [float(i)]}))
    (tmp_path / "2020" / "GHCNh_DIR_2020.parquet").mkdir()
    assert jobs_of(spark, lambda: observations.list_files(spark, str(tmp_path))) == []
    files = observations.list_files(spark, f"file:{tmp_path}")
    assert files.rdd.getNumPartitions() <= 8
    listed = {r.file: r for r in files.collect()}
    seen = spark.read.format("binaryFile").load(f"{tmp_path}/2020/GHCNh_S*.parquet").selectExpr("path", "length", "cast(modificationTime as timestamp_ntz) as at")
    assert {f: (r.size, r.modified_at) for f, r in listed.items()} == {r.path: (r.length, r.at) for r in seen.collect()}
    odd = [f"S{i}" for i in range(90) if i % 2]
    kept = []
    tasks = jobs_of(spark, lambda: kept.append(observations.read_observations(spark, str(tmp_path), [2020], odd)))
    assert max(tasks) <= 8 < len(odd)
    assert sorted(r.temperature for r in kept[0].collect()) == [float(i) for i in range(90) if i % 2]
    assert len(kept[0].inputFiles()) == 45
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_the_listing_passes_over_folders_that_are_not_there(spark, tmp_path):
    write(tmp_path, "A", "0000", pa.table({"DATE": [None], "temperature": [1.0]}))
    write(tmp_path, "B", 2020, pa.table({"DATE": ["2020-01-01T00:00:00"], "temperature": [2.0]}))
    names = lambda years: {r.station_id for r in observations.list_files(spark, str(tmp_path), years).collect()}
    assert (names(None), names([0]), names([1999, 2020]), names([1999]), names([])) == ({"A", "B"}, {"A"}, {"B"}, set(), set())
    with pytest.raises(FileNotFoundError):
        observations.read_observations(spark, str(tmp_path), [1999])
