"""Feeds as a stream: every trigger polls them, and entries that an earlier poll gave are left out."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gazette.sources.feeds import FeedSource, FeedTasks


class FeedStream(DataSource):
    """spark.readStream.format("feed_stream"): the columns of FeedSource and polled_at. Options as there; polled_feeds() gives
    the fetcher. An offset is the time of a poll, so each trigger asks all feeds again, in tasks. A batch that is run again
    after a failure asks again too; which entries are new is for the state behind it to say."""

    fetch: Callable[[str], str]

    @classmethod
    def name(cls) -> str:
        return "feed_stream"

    def schema(self) -> str:
        return f"{FeedSource.COLUMNS}, polled_at timestamp"

    def streamReader(self, schema):
        return _Polls(type(self).fetch, json.loads(self.options["catalog"]), int(self.options["concurrency"]))


class _Polls(DataSourceStreamReader):
    def __init__(self, fetch: Callable[[str], str], rows: list, concurrency: int):
        self.tasks = FeedTasks(fetch, rows, concurrency)

    def initialOffset(self) -> dict:
        return {"polled": 0}

    def latestOffset(self) -> dict:
        return {"polled": time.time_ns() // 1000}

    def partitions(self, start: dict, end: dict):
        return [InputPartition((end["polled"], rows)) for rows in self.tasks.dealt()]

    def read(self, partition):
        import datetime

        polled, rows = partition.value
        at = datetime.datetime.fromtimestamp(polled / 1e6, datetime.timezone.utc)
        for row in self.tasks.read(rows):
            yield (*row, at)

    def commit(self, end: dict) -> None:
        pass


def polled_feeds(spark: SparkSession, sources: DataFrame, fetch: Callable[[str], str], concurrency: int = 8) -> DataFrame:
    """A stream of src_pos, entry_pos, entry, error, polled_at: all that each poll finds."""
    spark.dataSource.register(type("PolledFeeds", (FeedStream,), {"fetch": staticmethod(fetch)}))
    rows = [tuple(r) for r in sources.select("src_pos", "name", "rss").collect()]  # a catalog, not data
    return spark.readStream.format("feed_stream").option("catalog", json.dumps(rows)).option("concurrency", concurrency).load()


def new_entries(polls: DataFrame, remembered: str | None = None) -> DataFrame:
    """The entries that no earlier poll of their feed gave, restarts included, by link and title (or by position, without either);
    failed polls are all kept.

    The keys seen are state in the stream's checkpoint, split by key. With `remembered` (an interval) a key is forgotten so long
    after it was first seen; a feed that still has it then gives it again.
    """
    e = F.col("entry")
    keyed = polls.withColumn("entry_key", F.when(F.col("error").isNotNull(), F.concat(F.lit("error "), F.col("polled_at").cast("string"))).otherwise(F.sha2(F.to_json(F.struct(e["link"], e["title"], F.when(e["link"].isNull() & e["title"].isNull(), F.col("entry_pos")).alias("at"))), 256)))
    if remembered:
        return keyed.withWatermark("polled_at", remembered).dropDuplicatesWithinWatermark(["src_pos", "entry_key"])
    return keyed.dropDuplicates(["src_pos", "entry_key"])
