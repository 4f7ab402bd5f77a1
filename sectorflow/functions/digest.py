"""Numbers from MD5 digests: the same for the same values in any engine, order and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 12  # hexadecimal: 48 bits


def digest(seed: int, *columns: str | Column) -> Column:
    """A number below 2^48 from a seed and the columns as text, null as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")


def uniform(seed: int, *columns: str | Column) -> Column:
    """The same as a number in (0, 1)."""
    return (digest(seed, *columns) + 0.5) / float(1 << 4 * DIGITS)
