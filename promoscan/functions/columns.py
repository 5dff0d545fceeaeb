"""Column expressions. All are built-in functions, so they stay in whole-stage codegen."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    ACTIVE,
    ACTIVE_MAX_SCANS,
    CSV_NULL_TOKENS,
    EMPTY_PRIZE_TOKENS,
    EPOCH_DIGITS,
    FALSE_WORDS,
    GRANULARITIES,
    NOVICE,
    POWER,
    RECEIVED_TOKENS,
    REGION_NAMES,
    TRUE_WORDS,
    check_choice,
)

_UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")
EPOCH_MICROS = {"s": 1_000_000, "ms": 1_000, "us": 1, "ns": 0}  # 0: a thousandth
MICROS_PER_HOUR = 3_600_000_000
MICROS_PER_DAY = 24 * MICROS_PER_HOUR

# Year first, then optional time, fraction and offset. A bare year is no date.
_ISO = (
    r"^\d{4}-\d{1,2}-\d{1,2}"
    r"(?:[ T]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:Z|[+-]\d{2}:?(?:\d{2})?)?)?$"
)
# What one letter group of a datetime pattern reads; other letters aren't known here.
_GROUPS = {"yyyy": r"\d{4}", "MMM": r"\p{L}{3}", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}", "HH": r"\d{2}",
           "H": r"\d{1,2}", "hh": r"\d{2}", "h": r"\d{1,2}", "mm": r"\d{2}", "ss": r"\d{2}", "a": r"[AaPp][Mm]"}
_OFFSET = r":.*[+-]\d{2}:?(?:\d{2})?$"
# All characters that Python strips; Spark's plain trim removes spaces only.
_WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Remove all leading and trailing white space."""
    return F.btrim(text, F.lit(_WHITE_SPACE))


def null_if_token(text: Column) -> Column:
    return F.when(~text.isin(*CSV_NULL_TOKENS), text)


def ntz(value) -> Column:
    """A UTC wall-clock literal from text, ``datetime`` or an existing column."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def instant_to_utc(instant: Column) -> Column:
    """An instant as its UTC wall clock, whatever the session zone is."""
    return F.timestamp_add(
        "MICROSECOND", F.unix_micros(instant), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    )


def is_iso(t: Column) -> Column:
    return t.rlike(_ISO)


def format_shape(pattern: str) -> str:
    """A regular expression of the texts that a datetime pattern can read; equal for rival patterns."""
    if pattern in EPOCH_DIGITS:
        return rf"^\d{{{EPOCH_DIGITS[pattern]}}}$"
    out = ""
    for part in re.finditer(r"'(?P<quoted>[^']*)'|(?P<letters>([A-Za-z])\3*)|(?P<bracket>[\[\]])|.", pattern):
        letters = part["letters"]
        if part["quoted"] is not None:
            out += re.escape(part["quoted"])
        elif part["bracket"]:
            out += "(?:" if part[0] == "[" else ")?"
        elif not letters:
            out += re.escape(part[0])
        elif set(letters) == {"S"}:
            out += rf"\d{{1,{len(letters)}}}"
        elif letters in _GROUPS:
            out += _GROUPS[letters]
        else:
            raise ValueError(f"unknown letters {letters!r} in the date format {pattern!r}")
    return f"^{out}$"


def read_format(t: Column, pattern: str) -> Column:
    """Text of one form as a UTC wall clock, else null."""
    if pattern in EPOCH_DIGITS:
        return F.when(t.rlike(format_shape(pattern)), epoch_to_utc(t.try_cast("bigint"), pattern.split()[1]))
    # read and shown in the session zone, so the wall clock is that of the text
    return F.try_to_timestamp(t, F.lit(pattern)).cast("timestamp_ntz")


def parse_utc(t: Column, formats: Sequence[str] = ()) -> Column:
    """ISO-8601 text to a UTC wall clock; text without an offset is UTC; anything else is null.

    ``formats`` are datetime patterns without a zone, or names of ``EPOCH_DIGITS``, tried in order on
    text that isn't ISO.

    The text must be stripped. A cast to a wall clock ignores ``Z`` and needs no session zone; only text with another
    offset has to go by way of an instant.
    """
    zoned = F.regexp_replace(t, r"\s+([+-])", "$1").try_cast("timestamp")
    iso = F.when(
        is_iso(t),
        F.when(t.rlike(_OFFSET), instant_to_utc(zoned)).otherwise(t.try_cast("timestamp_ntz")),
    )
    return F.coalesce(iso, *[read_format(t, f) for f in formats]) if formats else iso


def epoch_to_utc(number: Column, unit: str) -> Column:
    """A number of ``unit`` since 1970 as a UTC wall clock; parts of a microsecond are cut off, NaN is null.

    Of floating point numbers the whole units count: a double is exact to a quarter of a microsecond in nanoseconds of today.
    """
    check_choice("epoch unit", unit, tuple(EPOCH_MICROS))
    per_unit = EPOCH_MICROS[unit]
    exact = number.try_cast("decimal(20,0)")
    micros = exact * F.lit(per_unit) if per_unit else F.floor(exact / F.lit(1000))
    return instant_to_utc(F.timestamp_micros(micros.try_cast("bigint")))


def to_utc_column(
    col: Column, data_type: T.DataType, formats: Sequence[str] = (), epoch_unit: str = "ns"
) -> Column:
    """A date column of any stored type as a UTC wall clock; text must be stripped.

    Numbers count ``epoch_unit`` since 1970.
    """
    if isinstance(data_type, T.TimestampNTZType):
        return col
    if isinstance(data_type, T.TimestampType):
        return instant_to_utc(col)
    if isinstance(data_type, T.DateType):
        return col.cast("timestamp_ntz")
    if isinstance(data_type, T.IntegralType):
        return epoch_to_utc(col, epoch_unit)
    if isinstance(data_type, T.NumericType):
        # beyond this, and for NaN, there is no whole number to read
        return epoch_to_utc(F.when(F.abs(col) < 9.2e18, F.floor(col)), epoch_unit)
    return parse_utc(col.cast("string"), formats)


def whole_number(text: Column) -> Column:
    """Text of a whole number, maybe with ``.0``, as a bigint; anything else is null."""
    digits = F.regexp_extract(strip(text), r"^([+-]?\d+)(?:\.0*)?$", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def sql_flag(text: Column) -> Column:
    """A flag as SQL reads it: true, false, or null for what is neither."""
    word = F.lower(strip(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def _session_is_utc() -> bool:
    """Whether casts between wall clocks and instants, as planned now, leave the value alone."""
    session = SparkSession.getActiveSession()
    return session is not None and session.conf.get("spark.sql.session.timeZone") in _UTC_NAMES


def local_time(utc: Column, tz: str) -> Column:
    """The wall clock of ``tz``. In a UTC session by the cheaper function, which looks the zone
    up once instead of once per row."""
    if tz == "UTC":
        return utc
    if _session_is_utc():
        return F.from_utc_timestamp(utc.cast("timestamp"), tz).cast("timestamp_ntz")
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)


def clean_prize_id(col: Column, data_type: T.DataType) -> Column:
    """Numbers stay as they are; of (stripped) text, empty words become null."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col), col)
    if isinstance(data_type, T.NumericType):
        return col
    return F.when(~F.lower(col.cast("string")).isin(*EMPTY_PRIZE_TOKENS), col.cast("string"))


def received_flag(col: Column) -> Column:
    """True for the accepted words in any case; not stripped; null is false."""
    return F.coalesce(F.lower(col.cast("string")).isin(*RECEIVED_TOKENS), F.lit(False))


def region_number(col: Column, data_type: T.DataType) -> Column:
    """A region id as a whole number, null if it is none."""
    if isinstance(data_type, T.IntegralType):
        return col.cast("bigint")
    number = col.cast("string").try_cast("double")
    return F.when(number == F.floor(number), number.try_cast("bigint"))


def region_label(number: Column, col: Column, names=None) -> Column:
    """Mapped name, else the id as text (whole numbers without ``.0``); null gives ``nan``."""
    label = F.coalesce(number.cast("string"), col.cast("string"), F.lit("nan"))
    for region, name in (REGION_NAMES if names is None else names).items():
        label = F.when(number == region, F.lit(name)).otherwise(label)
    return label


def segment_label(scans: Column) -> Column:
    """Segment by number of scans. Zero, the count of a missing user, falls in the middle one."""
    return (
        F.when(scans == 1, F.lit(NOVICE))
        .when(scans <= ACTIVE_MAX_SCANS, F.lit(ACTIVE))
        .otherwise(F.lit(POWER))
    )


def time_bucket(local: Column, granularity: str) -> Column:
    """Start day of the local day, Monday week or month."""
    check_choice("granularity", granularity, GRANULARITIES)
    day = F.to_date(local)
    return day if granularity == "Day" else F.trunc(day, granularity.upper())


def week_start(local: Column) -> Column:
    return time_bucket(local, "Week")


def bucket_step(granularity: str) -> Column:
    check_choice("granularity", granularity, GRANULARITIES)
    unit = {"Day": "1 day", "Week": "7 days", "Month": "1 month"}[granularity]
    return F.expr(f"INTERVAL {unit}")


def micros_between(start: Column, end: Column) -> Column:
    if _session_is_utc():
        return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.timestamp_diff("MICROSECOND", start, end)


def hours(micros: Column) -> Column:
    return micros / F.lit(float(MICROS_PER_HOUR))


def round_even(value: Column, digits: int) -> Column:
    """Round half to even, as NumPy does."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def rate(num: Column, den: Column) -> Column:
    """Share as a double, zero when there is nothing to divide by."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
