"""Display values computed by the source application's client, as column
expressions: F9 weight_label, F10 cz_date / cz_time, F11 elapsed_label,
F12 last_value_label, D1 minutes_between / session_minutes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Czech short date and 24-hour time as the client shows them
# ("2. 1. 2026", "09:05"), and the weight unit.
CZ_DATE_FORMAT = "d. M. yyyy"
CZ_TIME_FORMAT = "HH:mm"
WEIGHT_UNIT = "kg"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def weight_label(w: Column | str) -> Column:
    """``"<w> kg"``; empty when NULL (a 0.00 still shows)."""
    return F.when(_c(w).isNotNull(), F.concat(_c(w).cast("string"), F.lit(" " + WEIGHT_UNIT))).otherwise(F.lit(""))


def cz_date(ts: Column | str) -> Column:
    """``d. M. yyyy``."""
    return F.date_format(_c(ts), CZ_DATE_FORMAT)


def cz_time(ts: Column | str) -> Column:
    """``HH:mm``."""
    return F.date_format(_c(ts), CZ_TIME_FORMAT)


def elapsed_label(seconds: Column | str) -> Column:
    """``m:ss`` from whole seconds."""
    s = _c(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def seconds_between(a: Column | str, b: Column | str) -> Column:
    return F.timestamp_diff("SECOND", _c(a), _c(b))


def minutes_between(a: Column | str, b: Column | str) -> Column:
    """``floor(seconds / 60)`` from ``a`` to ``b``."""
    return F.floor(seconds_between(a, b) / 60).cast("long")


def session_minutes(started: Column | str, finished: Column | str, as_of: Column | str) -> Column:
    """D1 in batch form: minutes to ``finished`` when set, else to ``as_of``."""
    return minutes_between(started, F.coalesce(_c(finished), _c(as_of)))


def last_value_label(w: Column | str, ts: Column | str) -> Column:
    """``Last time: <w> kg (<d. M. yyyy>)``; NULL when there is no
    value to show."""
    return F.when(_c(w).isNotNull(), F.concat(F.lit("Last time: "), weight_label(w), F.lit(" ("), cz_date(ts),
                                              F.lit(")")))
