"""Identity of a meeting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(fips: Column, meeting_date: Column, meeting_type: Column) -> Column:
    """First 16 hex digits of SHA-1 over ``fips|YYYY-MM-DD|type``."""
    key = F.concat_ws("|", fips, meeting_date.cast("string"), meeting_type)
    return F.substring(F.sha1(key), 1, 16)


def hash_rank(seed: int, key: Column) -> Column:
    """Order for a seeded sample, computable by any engine that has SHA-1."""
    return F.sha1(F.concat(F.lit(f"{seed}|"), key))
