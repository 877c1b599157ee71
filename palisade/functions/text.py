"""Text helpers with the service's trimming rules."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters and space: what a JVM-style trim removes. Spark's trim removes spaces only.
_TRIMMED = "".join(map(chr, range(33)))


def jtrim(col: Column) -> Column:
    return F.btrim(col, F.lit(_TRIMMED))


def has_text(col: Column) -> Column:
    """Non-null with at least one non-whitespace character; never null itself."""
    return F.coalesce(F.rlike(col, F.lit(r"\P{javaWhitespace}")), F.lit(False))


def normalise(col: Column) -> Column:
    return F.upper(jtrim(col))


def or_unknown(col: Column) -> Column:
    """Null or blank becomes ``UNKNOWN``; applied before grouping, so that a missing value
    cannot be confused with the null a grouping set produces."""
    return F.when(has_text(col), col).otherwise(F.lit("UNKNOWN"))
