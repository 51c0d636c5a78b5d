"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions.staging import free_names
from gazette.storage import fresh, remove, stored

__all__ = ["WORD", "free_names", "fresh", "parted", "remainder", "remove", "stored", "table", "unsent", "within"]

#: A word: a run of anything but the six ASCII white space characters. bytes.split() cuts UTF-8 in the same places.
WORD = r"[^\x20\x09-\x0D]+"


def remainder(key: Column, by: int) -> Column:
    """crc32(key as text) mod by; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def within(key: Column, share: float | Column) -> Column:
    """Whether a 64-bit hash is among the least `share` of all hashes: a sample that no sort and no task sees whole."""
    if isinstance(share, Column):
        return (key / F.lit(float(2**64)) + F.lit(0.5)) <= share
    return key <= F.lit(int(-(2**63) + min(1.0, share) * (2**64 - 1025)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unsent(df: DataFrame) -> DataFrame:
    """df, for a join that must not broadcast it: Spark sizes a table by its packed files and as it is before an explode, so that one
    taken for small may not fit a driver."""
    return df.hint("merge")


def parted(df: DataFrame, key: Column, keys: DataFrame, bits: int = 1 << 25) -> tuple[DataFrame, DataFrame]:
    """df's rows whose key may be in `keys` (one column), and those whose key is not: these need no join, so are not shuffled.

    The keys are hashed to a bitmap of `bits` bits in rows of 4 KB, which is broadcast: 4 MB at most, however many keys there are. The
    more of its bits are set, the more rows are sent to the join in vain; none that has a key there is ever missed.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    row, bitmap = free_names(df.columns, "_row", "_bitmap")
    placed = keys.select(place(F.col(keys.columns[0])).alias("at"))
    sieve = placed.groupBy(F.bitmap_bucket_number("at").alias(row)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(bitmap))
    spot = F.bitmap_bit_position(place(key)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), F.shiftright(spot, 3) + 1, F.lit(1))), 16, 10).cast("long")
    found = df.withColumn(row, F.bitmap_bucket_number(place(key))).join(F.broadcast(stored(sieve, "sieve")), row, "left")
    may = F.coalesce(F.getbit(byte, spot % 8), F.lit(0)) == 1
    return found.where(may).select(*df.columns), found.where(~may).select(*df.columns)
