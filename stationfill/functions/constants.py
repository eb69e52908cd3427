"""Fixed values of the archive's file format and of the study design."""

# Columns every observation file carries.
PRIMARY_COLUMNS = ("STATION", "Station_name", "DATE", "LATITUDE", "LONGITUDE")

# Weather variables by how often stations report them.
TIER1_VARIABLES = (
    "temperature",
    "dew_point_temperature",
    "sea_level_pressure",
    "wind_direction",
    "wind_speed",
    "relative_humidity",
)
TIER2_VARIABLES = ("visibility", "wind_gust", "precipitation")
ALL_VARIABLES = TIER1_VARIABLES + TIER2_VARIABLES

# Attribute columns that follow each variable.
ATTRIBUTE_SUFFIXES = ("", "_Quality_Code", "_Measurement_Code", "_Report_Type_Code", "_Source_Code", "_units")

# Numeric columns that some file generations store as text or structs.
NUMERIC_COLUMNS = (
    "temperature",
    "dew_point_temperature",
    "station_level_pressure",
    "sea_level_pressure",
    "wind_direction",
    "wind_speed",
    "wind_gust",
    "relative_humidity",
    "wet_bulb_temperature",
    "visibility",
    "precipitation",
    "pressure_3hr_change",
    "altimeter",
    "snow_depth",
    "Latitude",
    "Longitude",
    "Elevation",
)

# Report types that summarise several hours.
SUMMARY_REPORT_TYPES = (
    "FM-12",
    "FM12-SYNOP",
    "FM-13",
    "FM-14",
    "FM-18",
    "SY-AE",
    "SY-AU",
    "SY-MT",
    "SY-SA",
    "AERO",
)

# Quality codes, by how a file stores them.
VALID_CODES_INTEGER = (1, 5)
VALID_CODES_TEXT = ("", "1", "5", "A", "C")
INVALID_CODES_INTEGER = (3, 7)
INVALID_CODES_TEXT = ("3", "7", "L", "o", "F", "I", "M", "N", "R", "S", "W", "X", "Z")
ERRONEOUS_CODES = ("3", "7")
SUSPECT_CODES = ("2", "6")

# Id prefixes of the North America subset.
NORTH_AMERICA_PREFIXES = ("US", "CA", "MX", "RQ", "VQ")

# Coordinate limits and the marker for an unknown elevation.
LATITUDE_RANGE = (-90.0, 90.0)
LONGITUDE_RANGE = (-180.0, 180.0)
ELEVATION_RANGE = (-500.0, 9000.0)
ELEVATION_UNKNOWN = -999.9

# Fixed value: version stamped on station metadata.
METADATA_SCHEMA_VERSION = "2.0"

# Gap length classes in hours (upper bounds are inclusive).
SHORT_GAP_HOURS = 6
MEDIUM_GAP_HOURS = 72

# Realistic gap lengths, as (share, shortest, longest) in hours.
EMPIRICAL_GAPS = ((0.5, 1, 6), (0.4, 6, 72), (0.1, 72, 336))
LOGNORMAL_GAP_MEAN = 1.0
LOGNORMAL_GAP_STD = 1.5
LONGEST_REALISTIC_GAP = 336

# Scoring strata.
GAP_LENGTH_BINS = (6, 24, 72, 168)
EXTREME_PERCENTILES = (5.0, 95.0)
