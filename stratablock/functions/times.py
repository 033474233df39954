"""Names of runs from their start, and how long something took."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 86_400_000_000


def stamp(start: Column) -> Column:
    """A start as text that sorts by time, such as 20240131_235959."""
    return F.date_format(start, "yyyyMMdd_HHmmss")


def elapsed(start: Column, end: Column) -> Column:
    """Seconds between two timestamps, with fractions: those of whole days and the rest, each a double, as SQL engines add an interval up."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    rest = micros % _DAY
    return (micros - rest) / F.lit(1e6) + rest / F.lit(1e6)


def elapsed_text(seconds: Column) -> Column:
    """Two digits of the double's exact value, as C and Python print it; ``format_string`` rounds its shortest decimal form, so that 1.775, which is a little less, became 1.78."""
    return F.concat(F.call_function("format_number", seconds, F.lit("0.00")), F.lit(" seconds"))


def rounded(seconds: Column, digits: int) -> Column:
    """Rounded by the double's product with a power of ten, as SQL engines round doubles; ``F.round`` rounds its shortest decimal form."""
    return F.round(seconds * 10.0**digits) / 10.0**digits
