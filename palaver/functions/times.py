"""Timestamps: ISO strings are UTC unless they say otherwise; bad ones are null, never errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import sanitize_name


def parse_iso(c: Column) -> Column:
    """Timestamp of an ISO string; falls back to its first ten characters. Session time zone: UTC."""
    return F.coalesce(c.try_cast("timestamp"), F.substring(c, 1, 10).try_cast("timestamp"))


def to_utc_iso(seconds: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss[.ffffff]Z`` of seconds since the epoch."""
    ts = F.timestamp_micros((seconds.cast("decimal(20,6)") * 1_000_000).cast("long"))
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("Z"))


def recency_boost(updated: Column, as_of: Column) -> Column:
    """max(0, 5 * (1 - days / 365)); 0 without a time; above 5 in the future."""
    days = (F.unix_micros(as_of) - F.unix_micros(updated)) / F.lit(86_400_000_000.0)
    return F.coalesce(F.greatest(F.lit(0.0), 5.0 * (1.0 - days / 365.0)), F.lit(0.0))


def local_time(ts: Column, zone: str = "UTC") -> Column:
    return F.from_utc_timestamp(ts, zone)


def display(c: Column, zone: str = "UTC") -> Column:
    """A time for people; what can't be parsed is shown as it is."""
    return F.coalesce(F.date_format(local_time(parse_iso(c), zone), "yyyy-MM-dd HH:mm:ss"), c, F.lit(""))


def file_date(c: Column) -> Column:
    return F.coalesce(F.date_format(parse_iso(c), "yyyy-MM-dd"), F.lit("unknown-date"))


def file_stem(created_at: Column, name: Column) -> Column:
    return F.concat(file_date(created_at), F.lit("_"), sanitize_name(name))
