"""Text forms of numbers, names and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_number(x: Column, digits: int = 4, missing: str = "NA") -> Column:
    """Fixed decimals; null and non-finite values as ``missing``."""
    return F.when(finite(x).isNotNull(), fixed(x, digits)).otherwise(missing)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value (``format_string`` would round its shortest decimal form)."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded by its binary value, halves away from zero (``round`` would round its shortest decimal form); too large ones have no such digits and stay."""
    size = F.abs(x) * 10.0**digits
    whole = F.floor(size)
    up = F.when(size - whole >= 0.5, whole + 1).otherwise(whole)
    return F.when(size < 2.0**52, F.signum(x) * up / 10.0**digits).otherwise(x)


def finite(x: Column) -> Column:
    """The value if it is finite, else null."""
    return F.when(F.abs(x) < float("inf"), x)


def numeric_tag(x: Column) -> Column:
    """A finite number written in a string, else null."""
    return finite(F.trim(x).try_cast("double"))


def utc_date(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def file_token(path: Column, channels: list[str]) -> Column:
    """The channel whose name (without "-A") is the longest found in a file name as it is written, the first of equals; null if none."""
    out = F.lit(None).cast("string")
    for c in sorted(reversed(channels), key=lambda c: len(c.removesuffix("-A"))):
        out = F.when(F.contains(path, F.lit(c.removesuffix("-A"))), c).otherwise(out)
    return out


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9._-]", "_")
