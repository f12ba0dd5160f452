"""Epoch milliseconds and timestamps, in UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def timestamp(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def utc(millis: Column) -> Column:
    """A timestamp without zone, as output tables hold it. Needs the session's time zone to be UTC."""
    return F.timestamp_millis(millis).cast("timestamp_ntz")
