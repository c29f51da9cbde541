"""Shared plumbing: scratch tables, binary files in the shared folder, id filters."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the hashed key filter, about 16 for each key between these bounds: a broadcast of at most 2**21 rows (32 MB).
FILTER_BITS = 16, 27
#: Rows of an Arrow batch where they are whole texts.
BATCH = 1000

_roots: dict[str, str] = {}
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Only where that setting is absent in local mode (tests) a temporary folder is
    set as the checkpoint folder instead; on a cluster, machines would not share it.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="keelson-")
            spark.sparkContext.setCheckpointDir(base)
        _roots[app] = f"{base.rstrip('/')}/keelson-{app}"
        atexit.register(drop_scratch, spark)
    return _roots[app]


def drop_scratch(spark: SparkSession) -> None:
    """Delete everything this application wrote to the shared folder."""
    root = _roots.pop(spark.sparkContext.applicationId if spark.sparkContext._jsc else "", None)
    if root:
        drop_path(spark, root)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing is created."""
    _written.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}")
    return _written[-1]


def settle_alone(spark: SparkSession, make, label: str) -> DataFrame:
    """``make()`` settled; the scratch tables that were written on the way are deleted."""
    before = len(_written)
    out = settle(make(), label)
    for path in _written[before:-1]:
        drop_path(spark, path)
    _written[before:-1] = []
    collect(spark)
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    with suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """(pyarrow file system, path in it) for a folder all machines see: file, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def _probe(key: str, bits: int):
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << bits))
    return F.shiftright(h, 6), (h % 64).cast("int")


def with_maybe(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: false if ``key`` is surely not among ``keys[key]`` (a settled table).

    A one-hash Bloom filter, sized by the number of keys within FILTER_BITS, built,
    broadcast and probed in the JVM.  With more keys than its bound is made for it only
    lets more rows through.
    """
    word, bit = _probe(key, min(max((16 * keys.count()).bit_length(), FILTER_BITS[0]), FILTER_BITS[1]))
    words = keys.select(word.alias("__w"), bit.alias("__b")).groupBy("__w").agg(
        F.bit_or(F.expr("shiftleft(1L, __b)")).alias("__bits"))
    return (df.withColumns({"__w": word, "__b": bit})
            .join(F.broadcast(words), "__w", "left")
            .withColumn(flag, F.coalesce(F.expr("shiftrightunsigned(__bits, __b) & 1L = 1L"), F.lit(False)))
            .drop("__w", "__b", "__bits"))


def rows_with(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``keys[key]``; wide rows that can't match are never shuffled."""
    maybe = with_maybe(df, key, keys, "__maybe").filter("__maybe").drop("__maybe")
    return maybe.join(keys.select(key).distinct(), key, "left_semi")


def rows_without(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` is not among ``keys[key]`` (null keys stay)."""
    flagged = with_maybe(df, key, keys, "__maybe")
    checked = flagged.filter("__maybe").join(keys.select(key).distinct(), key, "left_anti")
    return flagged.filter("not __maybe").unionByName(checked).drop("__maybe")


def salted_join(wide: DataFrame, narrow: DataFrame, key: str, counts: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """``wide`` joined with ``narrow`` (a row for each ``key``), hot keys split over many tasks.

    ``counts``: key and ``n``, about how many rows of ``wide`` have it (settled).  A key
    of more than a quarter of a task's even share is hot: there are at most four of them
    for each task, so they are broadcast whatever the input.  Rows of a hot key are dealt
    by the hash of ``spread`` over as many parts as it has such shares, and its row of
    ``narrow`` goes to each.
    """
    parts = 4 * partitions(wide.sparkSession)
    share = (counts.agg(F.sum("n")).first()[0] or 0) // parts + 1
    hot = F.broadcast(counts.filter(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("__parts")))
    splits = F.coalesce("__parts", F.lit(1))
    dealt = wide.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*spread), splits).cast("int")).drop("__parts")
    copies = narrow.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), splits - 1))).drop("__parts")
    return dealt.join(copies, [key, "__salt"], how).drop("__salt")


_kept: dict = {}


def only(key: object, make):
    """What a worker process keeps from task to task: the last thing asked for; what it held before is freed.

    Workers are reused by all operators of a session, so that each operator's caches would stay otherwise.
    """
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Free what this worker keeps: called first by tasks that keep nothing."""
    if _kept:
        _kept.clear()
        gc.collect()


def give_back() -> None:
    """What this process has freed goes back to the machine; the allocators would keep its peak."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def collect(spark: SparkSession) -> None:
    """The driver gives back the memory of plans and task records that settled tables have left behind.

    Its JVM would grow to its bound before it collects them: called between the steps of a query of
    many jobs.  Spark's cleaner then drops their shuffles and broadcasts, too.
    """
    give_back()  # first what this process refers to in the JVM
    spark._jvm.System.gc()


def trimmed(run):
    """``run``, a function for mapInArrow; what its task used goes back to the machine when it ends.

    Workers stay for a while after their last task.
    """
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH`` rows from here on in this session; a smaller setting of its owner stays.

    Rows are whole texts here, and a batch is held several times over: by the JVM's writer
    and reader, as Arrow, as Python texts, and as what is made of them.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
