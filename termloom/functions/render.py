"""Scalar values as metadata text. Null, NaN and blank become null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.text import blank_to_null

_NO_TRAILING_ZEROS = r"(?<=[.]\d{1,30})0+\z"


def _iso_timestamp(text: Column) -> Column:
    # Spark prints up to six fraction digits without trailing zeros; ISO text has none or six.
    iso = F.replace(text, F.lit(" "), F.lit("T"))
    return F.when(F.contains(iso, F.lit(".")), F.rpad(iso, 26, "0")).otherwise(iso)


def _plain_decimal(value: Column, scale: int) -> Column:
    return F.regexp_replace(value.cast(T.DecimalType(38, scale)).cast("string"), _NO_TRAILING_ZEROS, "")


def _double_text(value: Column) -> Column:
    """Shortest decimal text: plain digits from 1e-4 up to 1e16, exponent form outside."""
    java = value.cast("string")
    size = F.abs(value)
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"[.]0\z", "")
    exponent = F.substring_index(java, "E", -1).cast("int")
    sign = F.when(exponent < 0, "-").otherwise("+")
    digits = F.abs(exponent).cast("string")
    scientific = F.concat(
        mantissa, F.lit("e"), sign, F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    )
    return (
        F.when(F.isnan(value), F.lit(None))
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(~F.contains(java, F.lit("E")), java)
        .when((size >= 1e7) & (size < 1e16), _plain_decimal(value, 12))
        .when((size >= 1e-4) & (size < 1e-3), _plain_decimal(value, 25))
        .otherwise(scientific)
    )


def scalar_text(value: Column, data_type: T.DataType) -> Column:
    """Text of a scalar column, or null when there is nothing to keep."""
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return blank_to_null(value)
    if isinstance(data_type, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return _double_text(value.cast("double"))
    if isinstance(data_type, T.TimestampNTZType):
        return _iso_timestamp(value.cast("string"))
    if isinstance(data_type, T.TimestampType):
        return F.concat(_iso_timestamp(value.cast("string")), F.date_format(value, "xxx"))
    if isinstance(data_type, T.NullType):
        return F.lit(None).cast("string")
    if isinstance(data_type, T.BinaryType):
        raise ValueError("Binary columns have no text form; cast or drop them before canonicalising")
    return value.cast("string")
