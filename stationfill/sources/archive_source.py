"""The archive as one data source, whatever generations of files it holds.

    spark.dataSource.register(ArchiveSource)
    spark.read.format("station_archive").option("path", root).load()

or ``read_archive(spark, root)``, which also makes the time stamps. A partition is a share of a
year's folder: the task that reads it lists the folder, takes its share of the names and maps each
file's columns to one schema, so plans have one branch and no file name passes through the driver.
Only the columns that a query needs are asked of a file, once the schema is narrowed to them.

Options: ``path``; ``years`` ("2010,2012:2015") names folders, without it they are listed;
``stations`` ("USW1,CAX"); ``shares`` (8), tasks per folder; ``report`` ("rows"): with "files" there is
one row per file instead, with its columns and types, or the error of a file that is not readable as parquet.
Such files give no rows; any other error, an unreachable store say, is raised. With "listing" there is a row per
file with its size and the milliseconds of its last change, and nothing is opened. ``pushdown`` ("false"):
where ``spark.sql.python.filterPushdown.enabled`` is set, "true" lets filters on ``station_id`` and
``file_year`` decide which names are opened; ``read_archive`` sets it by itself.

Paths are spelled as Spark spells them (``file:``, ``s3a:``, ``gs:``, ``hdfs:``); tasks reach them
through Arrow's file systems.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import constants as C
from ..operators.reports import unify_timestamps
from .observations import _SCHEMES, FILE_PATTERN, _is_corrupt, parse_stations, parse_years

NAME = "station_archive"
#: Parts that a time is given in where a file has no date column.
TIME_PARTS = ("date", "year", "month", "day", "hour", "minute")
_NUMERIC = {name.lower() for name in C.NUMERIC_COLUMNS}
FILES_SCHEMA = "station_id string, year int, file string, column string, type string, error string"
LISTING_SCHEMA = "file string, station_id string, year int, size bigint, modified_ms bigint"
#: Files in a batch of the listing.
LISTED_AT_ONCE = 1 << 14


def lowered(name: str) -> str:
    """The one spelling of a column's name."""
    name = name.lower()
    return name.removesuffix("_code") if name.endswith("_report_type_code") else name


def columns() -> list[str]:
    """Every column that the format knows, in one spelling."""
    suffixes = [lowered(f"x{s}").removeprefix("x") for s in C.ATTRIBUTE_SUFFIXES]
    variables = [c.lower() for c in C.NUMERIC_COLUMNS if c.lower() not in ("latitude", "longitude", "elevation")]
    known = [c.lower() for c in C.PRIMARY_COLUMNS] + ["elevation", *TIME_PARTS]
    return list(dict.fromkeys(known + [v + s for v in variables for s in suffixes]))


def schema_of(names) -> T.StructType:
    """Numbers as doubles, the date as a time, all else as text; what tells the file comes first."""
    fields = [T.StructField("station_id", T.StringType()), T.StructField("file_year", T.IntegerType())]
    kinds = {"date": T.TimestampNTZType(), **{n: T.DoubleType() for n in _NUMERIC}}
    return T.StructType(fields + [T.StructField(n, kinds.get(n, T.StringType())) for n in names])


_ARROW = {T.DoubleType: pa.float64(), T.StringType: pa.string(), T.TimestampNTZType: pa.timestamp("us")}


def _number(column: pa.Array) -> pa.Array:
    if pa.types.is_struct(column.type):
        for i, f in enumerate(column.type):
            if pa.types.is_integer(f.type) or pa.types.is_floating(f.type):
                return pc.struct_field(column, [i]).cast(pa.float64(), safe=False)
        return pa.nulls(len(column), pa.float64())
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        bare = pc.utf8_trim_whitespace(column.cast(pa.string()))
        plain = pc.match_substring_regex(bare, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
        return pc.if_else(plain, bare, pa.scalar(None, pa.string())).cast(pa.float64())
    if pa.types.is_null(column.type):
        return pa.nulls(len(column), pa.float64())
    return column.cast(pa.float64(), safe=False)


def _text(column: pa.Array, code: bool) -> pa.Array:
    if pa.types.is_struct(column.type):
        whole = [i for i, f in enumerate(column.type) if pa.types.is_integer(f.type)]
        if not code or not column.type.num_fields:
            return pa.nulls(len(column), pa.string())
        return _text(pc.struct_field(column, [(whole or [0])[0]]), code)
    if pa.types.is_nested(column.type):
        return pa.nulls(len(column), pa.string())
    return column.cast(pa.string())


def _time(column: pa.Array) -> pa.Array:
    """Date and time from text to the second, or from a typed column as it is; zoned ones in UTC."""
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.timestamp("us", column.type.tz), safe=False).cast(pa.timestamp("us"))
    if pa.types.is_date(column.type):
        return column.cast(pa.timestamp("us"))
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return pc.strptime(column.cast(pa.string()), format="%Y-%m-%dT%H:%M:%S", unit="us", error_is_null=True)
    return pa.nulls(len(column), pa.timestamp("us"))


def unified(batch: pa.RecordBatch, wanted: list[tuple[str, pa.DataType]]) -> list[pa.Array]:
    """The wanted columns of a batch of any generation; of several spellings the first value that is not null."""
    spellings: dict[str, list[str]] = {}
    for name in batch.schema.names:
        spellings.setdefault(lowered(name), []).append(name)
    out = []
    for name, kind in wanted:
        variants = [batch.column(n) for n in spellings.get(name, [])]
        code = name.endswith("_quality_code")
        made = {pa.float64(): _number, pa.timestamp("us"): _time}.get(kind, lambda v: _text(v, code))  # noqa: B023
        found = [made(v) for v in variants]
        out.append(pc.coalesce(*found) if len(found) > 1 else found[0] if found else pa.nulls(batch.num_rows, kind))
    return out


@dataclass
class Share(InputPartition):
    """The files of a folder whose names hash to ``share`` of ``shares``."""

    folder: str
    share: int
    shares: int


@dataclass
class _Names:
    """Which files are wanted, by what their names say; None is all."""

    years: set[int] | None = None
    stations: set[str] | None = None
    ranges: list[tuple[str, int]] = field(default_factory=list)

    def has_year(self, year: int) -> bool:
        tests = {">": year.__gt__, ">=": year.__ge__, "<": year.__lt__, "<=": year.__le__}
        return (self.years is None or year in self.years) and all(tests[sign](limit) for sign, limit in self.ranges)

    def narrow(self, column: str, values: set) -> None:
        name = "years" if column == "file_year" else "stations"
        now = getattr(self, name)
        setattr(self, name, values if now is None else now & values)


def _system(uri: str):
    import pyarrow.fs as fs

    for ours, theirs in _SCHEMES:
        if uri.startswith(ours):
            uri = theirs + uri.removeprefix(ours).lstrip("/")
    if uri.startswith("file:"):
        uri = "file:///" + uri.removeprefix("file:").lstrip("/")
    elif "://" not in uri:
        uri = os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def write_archive(reports: DataFrame, root: str) -> DataFrame:
    """Lay reports out as an archive under ``root``; gives file, station_id, year and n of every file written.

    A file holds one station's year, in the order of time: that is what one task holds. Reports without a
    time go to year 0000. ``ts`` becomes the date, ``report_type`` that of the temperature; all other
    columns keep their names. A file appears whole or not at all, and a task that is run again
    writes the same file again. The result has to be read for the files to be written.
    """
    rows = reports.drop("year").withColumn("__year", F.coalesce(F.year("ts"), F.lit(0)))

    def write(table: pa.Table) -> pa.Table:
        import uuid

        import pyarrow.parquet as pq

        station, year = table.column("station_id")[0].as_py(), table.column("__year")[0].as_py()
        ordered = table.sort_by([(c, "ascending") for c in ("ts", "report_type") if c in table.column_names]).drop_columns(["__year"])
        spelled = {"ts": "DATE", "report_type": "temperature_Report_Type", "station_id": "STATION"}
        out = ordered.rename_columns([spelled.get(c, c) for c in ordered.column_names])
        system, folder = _system(f"{root.rstrip('/')}/{year:04d}")
        system.create_dir(folder, recursive=True)
        name, draft = f"{folder}/GHCNh_{station}_{year:04d}.parquet", f"{folder}/.{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as stream:
            pq.write_table(out, stream)
        system.move(draft, name)
        return pa.table({"file": [name], "station_id": [str(station)], "year": pa.array([year], pa.int32()), "n": [table.num_rows]})

    return rows.groupBy("station_id", "__year").applyInArrow(write, "file string, station_id string, year int, n bigint")


class ArchiveReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = schema.fieldNames()
        self.wanted = [(f.name, _ARROW.get(type(f.dataType))) for f in schema.fields if f.name not in ("station_id", "file_year")]
        self.root, self.shares = options["path"], int(options.get("shares", 8))
        self.report = options.get("report", "rows")
        if self.report not in ("rows", "files", "listing"):
            raise ValueError("report must be rows, files or listing")
        years, stations = parse_years(options.get("years")), parse_stations(options.get("stations"))
        self.given = years
        self.files = _Names(None if years is None else set(years), None if stations is None else set(stations))

    def partitions(self) -> list[Share]:
        if self.report == "listing":
            return [Share(f"{self.root.rstrip('/')}/{name}", i, self.shares) for name in self._folders() for i in range(self.shares)]
        years = self.given
        if years is None:
            import pyarrow.fs as fs

            system, path = _system(self.root)
            folders = system.get_file_info(fs.FileSelector(path))
            years = sorted(int(x.base_name) for x in folders if x.type == fs.FileType.Directory and re.fullmatch(r"\d{4}", x.base_name))
        return [Share(f"{self.root.rstrip('/')}/{y:04d}", i, self.shares) for y in years if self.files.has_year(y) for i in range(self.shares)]

    def _folders(self) -> list[str]:
        """Names of the folders to list: those of the years, or all."""
        if self.given is not None:
            return list(dict.fromkeys(name for y in self.given for name in (f"{y:04d}", str(y))))
        import pyarrow.fs as fs

        system, path = _system(self.root)
        found = system.get_file_info(fs.FileSelector(path))
        return sorted(x.base_name for x in found if x.type == fs.FileType.Directory and not x.base_name.startswith((".", "_")))

    def _listing(self, share: Share) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs

        system, path = _system(share.folder)
        rows = []
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            name = re.fullmatch(FILE_PATTERN, info.base_name)
            if name and info.type == fs.FileType.File and crc32(info.base_name.encode()) % share.shares == share.share:
                rows.append((f"{share.folder}/{info.base_name}", name[1], int(name[2]), info.size, (info.mtime_ns or 0) // 1_000_000))
        kinds = {"file": pa.string(), "station_id": pa.string(), "year": pa.int32(), "size": pa.int64(), "modified_ms": pa.int64()}
        for at in range(0, len(rows), LISTED_AT_ONCE):
            made = [pa.array(list(values), kind) for values, kind in zip(zip(*rows[at : at + LISTED_AT_ONCE]), kinds.values())]
            yield pa.RecordBatch.from_arrays(made, list(kinds))

    def read(self, share: Share | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        if share is None:  # what Spark gives where there is no partition
            return
        if self.report == "listing":
            yield from self._listing(share)
            return
        system, path = _system(share.folder)
        for info in sorted(system.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda x: x.base_name):
            name = re.search(FILE_PATTERN, info.base_name)
            if not name or crc32(info.base_name.encode()) % share.shares != share.share:
                continue
            station, year = name[1], int(name[2])
            if not self.files.has_year(year) or (self.files.stations is not None and station not in self.files.stations):
                continue
            # Only what parquet itself objects to marks a file as corrupt; reading on is not shielded.
            try:
                file = pq.ParquetFile(system.open_input_file(info.path))
            except Exception as error:
                if not _is_corrupt(error):
                    raise
                if self.report == "files":
                    yield self._described(station, year, info.path, [(None, None, str(error))])
                continue
            if self.report == "files":
                yield self._described(station, year, info.path, [(f.name, str(f.type), None) for f in file.schema_arrow])
                continue
            needed = {n for n, _ in self.wanted}
            present = [n for n in file.schema_arrow.names if lowered(n) in needed]
            for batch in file.iter_batches(columns=present):
                yield self._rows(station, year, batch)

    def _rows(self, station: str, year: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        made = {"station_id": pa.array([station] * n, pa.string()), "file_year": pa.array([year] * n, pa.int32())}
        made |= dict(zip((name for name, _ in self.wanted), unified(batch, self.wanted)))
        return pa.RecordBatch.from_pydict({name: made[name] for name in self.names})

    def _described(self, station: str, year: int, path: str, rows: list[tuple]) -> pa.RecordBatch:
        n, (names, kinds, errors) = len(rows), zip(*rows) if rows else ((), (), ())
        made = [[station] * n, [year] * n, [path] * n, names, kinds, errors]
        kinds = [pa.int32() if c == "year" else pa.string() for c in ("station_id", "year", "file", "column", "type", "error")]
        arrays = [pa.array(list(v), k) for v, k in zip(made, kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["station_id", "year", "file", "column", "type", "error"])


class PushingReader(ArchiveReader):
    """The reader where Spark hands filters on; Spark refuses such a reader while that is switched off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        year = "year" if self.report == "files" else "file_year"
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("station_id", year) and isinstance(f, (EqualTo, In)):
                self.files.narrow("file_year" if column == year else column, set(f.value if isinstance(f, In) else [f.value]))
            elif column == year and type(f) in signs:
                self.files.ranges.append((signs[type(f)], f.value))
            else:
                yield f


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return {"files": FILES_SCHEMA, "listing": LISTING_SCHEMA}.get(self.options.get("report")) or schema_of(columns())

    def reader(self, schema: T.StructType) -> ArchiveReader:
        kind = PushingReader if self.options.get("pushdown") == "true" else ArchiveReader
        return kind(schema, dict(self.options))


def _load(spark: SparkSession, root: str, years, stations, **options):
    spark.dataSource.register(ArchiveSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(NAME).option("path", root).option("pushdown", pushdown)
    if years is not None:
        reader = reader.option("years", ",".join(map(str, years)) or "none")
    if stations is not None:
        reader = reader.option("stations", ",".join(stations) or ",none,")
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader


def read_archive(
    spark: SparkSession,
    root: str,
    years: list[int] | None = None,
    stations: list[str] | None = None,
    variables: list[str] | None = None,
    shares: int = 8,
) -> DataFrame:
    """The rows of ``observations.read_observations`` through one branch, with the columns of the format.

    ``variables`` names the variables to read, with all of their attributes; without it all known ones are.
    """
    wanted = columns()
    if variables is not None:
        own = tuple(v.lower() for v in variables)
        place = [c.lower() for c in C.PRIMARY_COLUMNS] + ["elevation", *TIME_PARTS, "temperature_report_type"]
        wanted = [c for c in wanted if c in place or c.startswith(own)]
    rows = _load(spark, root, years, stations, shares=shares).schema(schema_of(wanted)).load()
    stamped = unify_timestamps(rows).drop(*TIME_PARTS).withColumnRenamed("file_year", "year")
    return stamped.withColumn("report_type", F.col("temperature_report_type"))


def file_report(spark: SparkSession, root: str, years: list[int] | None = None, stations: list[str] | None = None, shares: int = 8) -> DataFrame:
    """Columns and types of every file from its footer, and the error of every file that has no usable one."""
    return _load(spark, root, years, stations, shares=shares, report="files").load()


def listing(spark: SparkSession, root: str, years: list[int] | None = None, shares: int = 8) -> DataFrame:
    """``file, station_id, year, size, modified_ms`` of every file, listed by tasks; paths as Spark spells them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return _load(spark, path, years, None, shares=shares, report="listing", pushdown="false").load()
