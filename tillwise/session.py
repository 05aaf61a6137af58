"""Session settings the jobs are written for, and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings. Joins carry no broadcast hints on tables that grow: Catalyst and AQE
# broadcast a side only while its measured size is under the threshold, and AQE splits a
# skewed partition of a sort-merge join otherwise. Generated methods beyond 8000 bytes are
# not compiled by the JIT; Spark then splits them instead of fusing the stage.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the runtime settings; extra settings by keyword with ``__`` for dots."""
    builder = SparkSession.builder.appName("tillwise")
    if master is not None:
        builder = builder.master(master)
    settings = dict(RUNTIME_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update({name.replace("__", "."): value for name, value in conf.items()})
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder every executor can reach, unique to this application.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset the warehouse
    takes its place, which Spark shares between driver and executors as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{named.rstrip('/')}/tillwise-{spark.sparkContext.applicationId}"


# Folders made inside each open ``cleared`` block, by purpose.
_made: list[list[tuple[str, str]]] = []


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the shared folder."""
    folder = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    for block in _made:
        block.append((purpose, folder))
    return folder


@contextmanager
def cleared(spark: SparkSession, *purposes: str) -> Iterator[None]:
    """Delete the folders made for these purposes when the block is done with them."""
    made: list[tuple[str, str]] = []
    _made.append(made)
    try:
        yield
    finally:
        _made.remove(made)
        for purpose, folder in made:
            if purpose in purposes:
                remove(spark, folder)


def stored(df: DataFrame, purpose: str, block_bytes: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For an intermediate result used several times: it cuts the lineage, survives lost
    executors and gives Catalyst a known size. ``block_bytes`` is the size of a file's row groups,
    which a task writes and reads whole; 128 MB by default.
    """
    spark = df.sparkSession
    path = new_folder(spark, purpose)
    writer = df.write if block_bytes is None else df.write.option("parquet.block.size", block_bytes)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def listing(spark: SparkSession, folder: str) -> tuple:
    """Names, lengths and modification times below a folder of any file system Spark reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library has written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears whole or not at all; False where there is one already.

    The text is written beside the path and renamed, which file systems refuse for a name
    that is taken.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_draft-{uuid.uuid4().hex}")
    files.mkdirs(target.getParent())
    stream = files.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not files.exists(target) and files.rename(draft, target):
        return True
    files.delete(draft, False)
    return False


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A runtime setting for the length of a block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession):
    """Files of a shuffle go with the query that made them, not when the driver happens to collect its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
