"""Scalar column helpers, all JVM-side built-ins (no Python UDFs).

``u(key, salt)`` is the deterministic uniform that replaces R's unseeded
``sample()``/``runif``: it depends only on the key and a salt string, so it is
identical at any partitioning, under task retries and recomputation, and is
reproduced bit-for-bit by the DuckDB oracle
``('0x'||substr(md5(k::varchar||'|salt'),1,13))::bigint/2^52``. 52 bits: a draw among
billions of rows must be able to reach each of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def u(key, salt: str | Column) -> Column:
    """Uniform in [0, 1) from md5(cast(key as string) || '|' || salt)."""
    salt_c = F.lit(salt) if isinstance(salt, str) else salt
    h = F.md5(F.concat(col_(key).cast("string"), F.lit("|"), salt_c))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(TWO_POW_52)


def label_number(c, digits: int = 3) -> Column:
    """a number rounded half-even for a label (R ``round(x, d)``)."""
    return F.bround(col_(c).cast("double"), digits)


def strip_suffix(c, n: int = 4) -> Column:
    """a string without its last ``n`` characters (R ``gsub(".{4}$", "", x)``); a
    shorter string stays as it is."""
    return F.regexp_replace(col_(c), f"(?s).{{{n}}}$", "")
