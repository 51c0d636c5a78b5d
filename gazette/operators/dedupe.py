"""Keep-latest deduplication by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_latest(df: DataFrame, keys: list[str], published: str, pos: str, duplicates: str | None = None) -> DataFrame:
    """One row a key: the latest, null times last, the earlier position of equals. Adds duplicate_count and first_pos.

    duplicate_count is the first row's own count (1 if there is no such column) and one for each other row. One hash
    aggregation with a partial one before its only shuffle, so a hot key is reduced where it lies.
    """
    own = F.col(duplicates) if duplicates else F.lit(1)
    rest = [c for c in df.columns if c not in keys and c != duplicates]
    order = F.struct(F.col(published).isNotNull(), F.col(published), -F.col(pos))
    agg = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), order).alias("_row"),
        (F.min_by(own, F.col(pos)) + F.count(F.lit(1)) - 1).cast("long").alias("duplicate_count"),
        F.min(pos).alias("first_pos"),
    )
    return agg.select(*keys, "_row.*", "duplicate_count", "first_pos")
