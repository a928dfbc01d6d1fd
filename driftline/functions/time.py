"""Times as unix seconds (``ctime``), calendar text and modified Julian dates, and codes derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MJD_OF_EPOCH = 40587.0  # fixed value: modified Julian date of 1970-01-01
SEASON_EPOCH, SEASON_YEAR = 949381200, 31557600  # fixed values: start of season 2000, seconds of a Julian year


def ctime_text(ctime: Column) -> Column:
    """``yyyy-mm-dd HH:MM:SS`` in UTC (the session's zone is UTC)."""
    return F.date_format(F.timestamp_seconds(F.floor(ctime)), "yyyy-MM-dd HH:mm:ss")


def text_ctime(text: Column) -> Column:
    """Unix seconds of a UTC date or date and time; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("long")


def ctime_mjd(ctime: Column) -> Column:
    return ctime / 86400.0 + MJD_OF_EPOCH


def mjd_ctime(mjd: Column) -> Column:
    return (mjd - MJD_OF_EPOCH) * 86400.0


def season(ctime: Column) -> Column:
    """Observing season of a time."""
    return ((ctime - SEASON_EPOCH) / SEASON_YEAR + 2000).cast("int")


def night_name(ctime: Column) -> Column:
    """Date of the night, as used in paths."""
    return F.date_format(F.timestamp_seconds(ctime), "yyyy-MM-dd")


def first_five(name: Column) -> Column:
    """First five digits of the leading ctime of a name, the path code of its archive folder."""
    return F.substring(name, 1, 5)
