"""Column rules for report types, quality codes and timestamps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC_TYPES = INTEGER_TYPES + (T.FloatType, T.DoubleType)


def is_hourly_report(report_type: Column) -> Column:
    """True unless the type is, or starts with, a summary type; unknown and NULL are kept."""
    summary = reduce(lambda a, b: a | b, [report_type.startswith(kind) for kind in C.SUMMARY_REPORT_TYPES])
    return ~F.coalesce(summary, F.lit(False))


def valid_code(code: Column, data_type: T.DataType) -> Column:
    """Statistics policy: a missing code counts as valid."""
    accepted = C.VALID_CODES_INTEGER if isinstance(data_type, INTEGER_TYPES) else C.VALID_CODES_TEXT
    return code.isNull() | code.isin(*accepted)


def invalid_code(code: Column, data_type: T.DataType) -> Column:
    rejected = C.INVALID_CODES_INTEGER if isinstance(data_type, INTEGER_TYPES) else C.INVALID_CODES_TEXT
    return F.coalesce(code.isin(*rejected), F.lit(False))


def blank_flagged(value: Column, code: Column, erroneous: bool = True, suspect: bool = False) -> Column:
    """Preparation policy: NULL the value under a bad code, keep it under a missing one."""
    codes = (C.ERRONEOUS_CODES if erroneous else ()) + (C.SUSPECT_CODES if suspect else ())
    if not codes:
        return value
    return F.when(F.coalesce(code.cast("string").isin(*codes), F.lit(False)), None).otherwise(value)


def plain_number(column: Column, data_type: T.DataType) -> Column:
    """Double from a number, text or a struct's first numeric field; unreadable text gives NULL."""
    if isinstance(data_type, T.StructType):
        for field in data_type.fields:
            if isinstance(field.dataType, NUMERIC_TYPES):
                return column.getField(field.name).cast("double")
        return F.lit(None).cast("double")
    return column.try_cast("double")


def plain_code(column: Column, data_type: T.DataType) -> Column:
    """Quality code as text: a struct gives its first integer field, else its first field."""
    if isinstance(data_type, T.StructType):
        names = [f.name for f in data_type.fields if isinstance(f.dataType, INTEGER_TYPES)]
        return column.getField((names or data_type.names)[0]).cast("string")
    return column.cast("string")


def parsed_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz")


def timestamp_from_parts(year, month, day, hour, minute) -> Column:
    parts = [p.try_cast("int") for p in (year, month, day, hour, minute)]
    return F.try_make_timestamp_ntz(*parts, F.lit(0))
