"""Text and time-stamp helpers for logs and run ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of run ids and dashboard time stamps.
RUN_ID = r"^run-(\d{8}-\d{6})-[a-zA-Z0-9]+$"
RUN_TIME = r"(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2})"
STAMP = r"^(\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}) UTC$"


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def last_line(text: Column, wanted) -> Column:
    """Last line for which ``wanted(line)`` holds, trimmed; null if there is none."""
    return F.trim(F.try_element_at(F.filter(lines(text), wanted), F.lit(-1)))


def utc_seconds(time: Column) -> Column:
    """Epoch seconds of ``YYYY-MM-DD HH:MM:SS`` in UTC, null where that is no valid time.

    The cast reads the zone from the text, so the session's zone plays no part.  The text is
    used once: an expression used many times in a column is computed as many times.
    """
    return F.unix_seconds(F.concat(time, F.lit("Z")).try_cast("timestamp"))


def run_epoch(run_id: Column) -> Column:
    """Start time in a run id as epoch seconds, 0 when the id does not hold one."""
    digits = F.regexp_extract(run_id, RUN_ID, 1)
    return F.coalesce(utc_seconds(F.regexp_replace(digits, RUN_TIME, "$1-$2-$3 $4:$5:$6")), F.lit(0).cast("bigint"))


def parse_stamp(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS UTC`` as epoch seconds, else null."""
    return utc_seconds(F.regexp_extract(text, STAMP, 1))


def format_elapsed(seconds: Column) -> Column:
    total = F.greatest(F.lit(0), seconds.cast("bigint"))
    h = F.call_function("div", total, F.lit(3600))
    m = F.call_function("div", F.pmod(total, F.lit(3600)), F.lit(60))
    s = F.pmod(total, F.lit(60))
    return (
        F.when(seconds.isNull(), "-")
        .when(h > 0, F.format_string("%dh %02dm %02ds", h, m, s))
        .when(m > 0, F.format_string("%dm %02ds", m, s))
        .otherwise(F.format_string("%ds", s))
    )
