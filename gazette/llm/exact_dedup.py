"""Exact deduplication by a stateful stream whose keyed state lives on disk and never expires."""

from __future__ import annotations

import functools
import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.common import free_names, fresh, stored
from gazette.storage import get, names, put, remove

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: How many state stores a stream has; without it, one for each shuffle partition, each with files of some MB at any size.
STORES = "spark.sql.streaming.internal.stateStore.partitions"
#: What the stores of an executor share for their blocks and write buffers, outside its heap; else each takes what it likes.
BOUNDED = {"spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128"}


def normalised(text: Column) -> Column:
    """The text without its ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]", "")


def best_first(doc_id: str = "doc_id") -> Column:
    """Orders the rows of a group: most code points, then smallest id (null last), then the delivery and the row's number."""
    columns = {"less": -F.col("n_points"), "no_id": F.col(doc_id).isNull(), "id": F.col(doc_id), "delivery": F.col("delivery"), "row": F.col("row"), "locator": F.col("locator")}
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def locator(docs: DataFrame) -> Column:
    """Where a row's text is: its file, and its place there if Spark knows it (of a table read from Parquet)."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018 - resolves the names
        return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return F.struct(F.input_file_name().alias("file"), F.lit(None).cast("long").alias("row"))


class Home:
    """A folder of the shared storage that keeps the state of digests from one delivery of documents to the next.

    A delivery has a name that its caller gives. It is marked as begun, its digests are written, the state takes them in, and it is
    marked as done. A delivery that failed anywhere on the way is given again under its name and goes on where it was: digests that
    are complete are not written again, and the state's checkpoint takes each file in once. Until then no other is let in, so that
    nothing counts as held that was never handed out. A delivery that is done may be asked for again, and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def begin(self, name: str) -> tuple[str, bool]:
        """The delivery's number as text, which sorts by time, and whether it is done."""
        done = names(self.spark, f"{self.path}/done")
        key = hashlib.sha256(name.encode()).hexdigest()
        if key in done:
            return get(self.spark, f"{self.path}/done/{key}"), True
        number = f"{len(done):08d}"
        begun = get(self.spark, f"{self.path}/begun/{number}")
        if begun is None:
            put(self.spark, f"{self.path}/begun/{number}", name)
        elif begun != name:
            raise RuntimeError(f"delivery {begun!r} has not been finished: give it again before {name!r}")
        return number, False

    def digests(self, number: str) -> str:
        return f"{self.path}/digests/delivery_number={number}"

    def write(self, keyed: DataFrame, number: str) -> None:
        """The delivery's digests; the stream is never run while they are incomplete."""
        if "_SUCCESS" not in names(self.spark, self.digests(number)):
            keyed.write.mode("overwrite").parquet(self.digests(number))

    def finish(self, name: str, number: str) -> None:
        put(self.spark, f"{self.path}/done/{hashlib.sha256(name.encode()).hexdigest()}", number)


def digest_state(spark: SparkSession, home: str, schema, bytes_per_trigger: int = 1 << 30, rows_per_store: int = 4_000_000, most_batches: int = 16) -> DataFrame:
    """Stream the digests in home/digests through keyed state: per digest that more than one row has the number of rows, the row
    that stays and the first.

    The state is held by RocksDB on the executors' disks and its checkpoints in the shared folder; no watermark, so no
    digest is ever forgotten. Each micro-batch writes the keys it changed that more than one row has; a replayed batch overwrites
    what it wrote, and more than `most_batches` are made one. A home that has been used goes on: only files that are new to
    it are read.
    """
    digests_path = f"{home}/digests"
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_trigger).parquet(f"{digests_path}/*")
    earliest = F.struct("delivery", "row", "locator")
    state = stream.groupBy("digest").agg(F.min(best_first()).alias("best"), F.min(earliest).alias("earliest"), F.count(F.lit(1)).alias("group_size"))
    stores = max(spark.sparkContext.defaultParallelism, -(-spark.read.schema(schema).parquet(digests_path).count() // rows_per_store))
    own = {PROVIDER: ROCKSDB, STORES: str(stores), **{k: v for k, v in BOUNDED.items() if spark.conf.get(k, None) is None}}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        query = (
            state.writeStream.outputMode("update")
            .option("checkpointLocation", f"{home}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda changed, batch: changed.where("group_size > 1").write.mode("overwrite").parquet(f"{home}/changed/batch={batch:08d}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return latest_hits(spark, home, state.schema, most_batches)


def latest_hits(spark: SparkSession, home: str, schema, most_batches: int) -> DataFrame:
    """Of the batches' changed keys the latest each. `upto=n` holds what the batches up to n came to; those are no longer read,
    and go."""
    whole = [n for n in names(spark, f"{home}/hits") if "_SUCCESS" in names(spark, f"{home}/hits/{n}")]
    upto = whole[-1].split("=")[1] if whole else ""
    batches = [n for n in names(spark, f"{home}/changed") if n.split("=")[1] > upto]
    paths = [f"{home}/changed/{n}" for n in batches] + [f"{home}/hits/{n}" for n in whole[-1:]]
    if not paths:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(path).withColumn("batch", F.lit(path.rsplit("=", 1)[1])) for path in paths]
    changed = functools.reduce(DataFrame.unionByName, parts)
    latest = changed.groupBy("digest").agg(F.max_by(F.struct("best", "earliest", "group_size"), "batch").alias("last"))
    latest = latest.select("digest", "last.best", "last.earliest", "last.group_size")
    if len(batches) <= most_batches:
        return latest
    last = batches[-1].split("=")[1]
    latest.write.mode("overwrite").parquet(f"{home}/hits/upto={last}")
    for path in paths:
        remove(spark, path)
    return spark.read.schema(schema).parquet(f"{home}/hits/upto={last}")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_hex: int = 64, bytes_per_trigger: int = 1 << 30, home: str | None = None, delivery: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept, locator (of the row that stays), n_points.

    Two texts are equal when they are identical without ASCII white space. The row with the most code points stays, then
    the smallest id; of rows that agree in both, exactly one stays. A null text is the empty text; a null id sorts last
    and a group of null ids only has a null keep_id. An empty table gives no rows; other columns are not looked at.

    Where the state holds a digest more than once, the rows are regrouped on their full normalised bytes. Texts of one
    digest that differ (digest_hex below 64 makes that happen in tests) then form groups of their own.

    `home` is a folder of the shared storage that keeps the state from one `delivery` (a name that the caller gives) of documents
    to the next; without it, docs are the only delivery. With it, keep_id, group_size and kept tell of all deliveries so far, and
    a text that an earlier delivery has is read again at its locator (where that has a row) and compared; if it differs, an
    error is raised. A delivery that failed is to be given again under its name (see Home); its rows count once.
    """
    spark = docs.sparkSession
    if home is not None and delivery is None:
        raise ValueError("a delivery to a home needs a name")
    state, name = Home(spark, home or fresh(spark, "dedup")), delivery or "only"
    home = state.path
    delivery, done = state.begin(name)
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(normalised(F.col(text_col)), 256).alias("sha"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        F.monotonically_increasing_id().alias("row"),
        locator(docs).alias("locator"),
        F.lit(delivery).alias("delivery"),
    ).withColumn("digest", F.substring("sha", 1, digest_hex))
    if not done:
        state.write(keyed, delivery)
    digests = spark.read.schema(keyed.schema).parquet(state.digests(delivery))
    hits = stored(digest_state(spark, home, keyed.schema, bytes_per_trigger), "dedup-hits")
    if not done:
        state.finish(name, delivery)
    # Full bytes on hits: rows of a held digest, grouped on the whole normalised text (partly before the shuffle).
    # Eight bytes a digest find the rows, so that Spark can broadcast them while they are few; the bytes decide.
    few = stored(hits.select(F.xxhash64("digest").alias("key")).distinct(), "dedup-hit-keys")
    again = docs.select(normalised(F.col(text_col)).alias("norm"))
    again = again.withColumn("digest", F.substring(F.sha2("norm", 256), 1, digest_hex)).join(few, F.xxhash64("digest") == F.col("key"), "left_semi")
    texts = again.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    clashes = stored(texts.where("texts > 1").select("digest"), "dedup-clashes")
    earlier = stored(hits.where((F.col("earliest.delivery") != delivery) & F.col("earliest.locator.row").isNotNull()).select("digest", "earliest.locator"), "dedup-earlier")
    if not earlier.isEmpty():
        _same_bytes(again, earlier, text_col)

    out = digests.join(hits.withColumnRenamed("digest", "held"), F.col("digest") == F.col("held"), "left")
    if not clashes.isEmpty():
        out = _by_bytes(docs, delivery, clashes, id_col, text_col, digest_hex).unionByName(out.join(clashes, "digest", "left_anti").drop("held", "earliest"))
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.col("sha").alias("digest"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("best.row") == F.col("row")) & (F.col("best.delivery") == delivery))).alias("kept"),
        F.coalesce("best.locator", "locator").alias("locator"),
        "n_points",
    )


def _same_bytes(again: DataFrame, earlier: DataFrame, text_col: str) -> None:
    """Raises an error if a text of this delivery (digest, norm) is not the one at the locator of its digest's first row."""
    spark = again.sparkSession
    files = [r.file for r in earlier.select("locator.file").distinct().collect()]  # names of files, not rows
    there = spark.read.parquet(*files).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), normalised(F.col(text_col)).alias("was"))
    first = earlier.select("digest", F.col("locator.file").alias("file"), F.col("locator.row").alias("at"))
    found = there.join(first, ["file", "at"]).select("digest", "was").join(again.select("digest", "norm"), "digest")
    if not found.where("was <> norm").isEmpty():
        raise ValueError("texts of one digest differ between deliveries")


def _by_bytes(docs: DataFrame, delivery: str, clashes: DataFrame, id_col: str, text_col: str, digest_hex: int) -> DataFrame:
    """The rows of clashing digests, grouped by their normalised bytes themselves."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        normalised(F.col(text_col)).alias("norm"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
        F.monotonically_increasing_id().alias("row"),
        locator(docs).alias("locator"),
        F.lit(delivery).alias("delivery"),
    ).withColumn("sha", F.sha2("norm", 256)).withColumn("digest", F.substring("sha", 1, digest_hex))
    rows = stored(rows.join(clashes, "digest", "left_semi"), "dedup-clashing")
    best = rows.groupBy("norm").agg(F.min(best_first()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(best, "norm").drop("norm")


def kept_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay. Rows equal in id, length and bytes are one and the same document: one of them stays.

    The few ids that go are looked up, not the many that stay. Only rows whose id is null or repeated need more than the id.
    """
    decided = stored(decided.select("doc_id", "digest", "n_points", "kept"), "dedup-decided")
    went, doubted, *keys, of, sha, points = free_names(docs.columns, "_gone", "_unclear", "_k0", "_k1", "_k2", "_of", "_sha", "_points")
    gone = stored(decided.where("not kept and doc_id is not null").select(F.col("doc_id").alias(went)), "dedup-gone")
    unclear = stored(decided.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias(doubted)), "dedup-unclear")
    if unclear.isEmpty():
        return docs.join(gone, F.col(id_col) == F.col(went), "left_anti")
    same = F.col(id_col).eqNullSafe(F.col(doubted))
    clear = docs.join(unclear, same, "left_anti").join(gone, F.col(id_col) == F.col(went), "left_anti")
    key = [F.col(id_col), F.sha2(normalised(F.col(text_col)), 256), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")]
    rows = docs.join(unclear, same, "left_semi").withColumns(dict(zip(keys, key, strict=True))).dropDuplicates(keys)
    stay = decided.where("kept").select(F.col("doc_id").alias(of), F.col("digest").alias(sha), F.col("n_points").alias(points))
    on = F.col(keys[0]).eqNullSafe(F.col(of)) & (F.col(keys[1]) == F.col(sha)) & (F.col(keys[2]) == F.col(points))
    return clear.unionByName(rows.join(stay, on, "left_semi").select(*docs.columns))
