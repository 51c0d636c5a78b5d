"""The rows published on the local day of a moment."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def published_today(df: DataFrame, now: datetime, published: str = "published_at") -> DataFrame:
    """Rows whose instant is on now's calendar day at now's fixed offset (UTC if it has none); null times go.

    A range of instants, so that it reaches the scan.
    """
    now = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    start = (now.replace(hour=0, minute=0, second=0, microsecond=0) - now.utcoffset()).replace(tzinfo=None)
    kind = df.schema[published].dataType.simpleString()
    bound = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") if kind == "timestamp_ntz" else F.lit(f"{t.isoformat(sep=' ')}Z").cast("timestamp")
    return df.where((F.col(published) >= bound(start)) & (F.col(published) < bound(start + timedelta(days=1))))
