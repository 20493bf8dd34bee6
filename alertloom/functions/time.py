"""Time conversions. `ts` is TIMESTAMP_NTZ in UTC, `ts_us` its epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def whole_number(c: Column) -> Column:
    """A strict integer read: '12.5', blanks and words give NULL."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)\s*$", 1).try_cast("bigint")


def epoch_seconds(c: Column) -> Column:
    return F.timestamp_seconds(whole_number(c)).cast("timestamp_ntz")


def epoch_millis(c: Column) -> Column:
    return F.timestamp_millis(whole_number(c)).cast("timestamp_ntz")


def century(two_digit_year: Column) -> Column:
    """Years 69-99 mean 19xx, 00-68 mean 20xx."""
    return F.when(two_digit_year >= "69", "19").otherwise("20")


def bucket(us: Column, width_us: Column) -> Column:
    """floor(us / width), exact for long values of either sign."""
    return F.call_function("div", us - F.pmod(us, width_us), width_us)


def long_lit(n: int) -> Column:
    return F.lit(n).cast("long")


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")
