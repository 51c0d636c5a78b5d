"""The folder that driver and executors share: what a query computes once is written there, and can be removed again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Only a local session may leave it unset: then a temporary folder serves."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='gazette-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def root(spark: SparkSession) -> str:
    """The one folder of an application's intermediate data."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark)}/gazette-{app}-{uuid.uuid4().hex}"
    return _roots[app]


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the application's folder that nothing else uses."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: it is computed once, and a lost executor takes none of it along."""
    spark, path = df.sparkSession, fresh(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def metered(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """stored(df, name), and the metrics (aggregates by name) of its rows, which Spark gathers while they are written."""
    seen = Observation()
    out = stored(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), name)
    return out, seen.get


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder by Spark's own file system layer."""
    system, where = _at(spark, path)
    system.delete(where, True)


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole or not at all: under another name first, then renamed. One that is there is replaced."""
    system, where = _at(spark, path)
    _, draft = _at(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = system.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not system.rename(draft, where):
        system.delete(where, False)
        if not system.rename(draft, where):
            raise OSError(f"can't write {path}")


def get(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, null if there is none."""
    system, where = _at(spark, path)
    if not system.exists(where):
        return None
    source = system.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted; nothing if it isn't there. Drafts are left out."""
    system, where = _at(spark, folder)
    if not system.exists(where):
        return []
    return sorted(n for n in (x.getPath().getName() for x in system.listStatus(where)) if not n.endswith(".draft"))


def clear(spark: SparkSession) -> None:
    """Delete all that this application's queries have stored. DataFrames that they gave can't be read after it."""
    found = _roots.pop(spark.sparkContext.applicationId, None)
    if found:
        remove(spark, found)

