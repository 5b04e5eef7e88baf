"""Keys under which differently spelled category values are equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def category_key(value: Column) -> Column:
    """Trimmed, without double quotes, case ignored, runs of space, hyphen and underscore alike; null stays null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(value.cast("string"), '"', ""), r"^\s+|\s+$", ""))
    return F.regexp_replace(F.lower(bare), r"[\s_-]+", "_")
