"""Random numbers that any engine can repeat: the leading 52 bits of an MD5 digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(*keys: Column | str | int) -> Column:
    """A 52-bit number from the texts of the keys, joined by bars; null keys are passed over."""
    texts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts).cast("binary")), 1, 13), 16, 10).cast("long")


def uniform(*keys: Column | str | int) -> Column:
    """A number strictly between 0 and 1 from the keys."""
    return (digits(*keys) + 1) / float((1 << 52) + 1)
