"""Shared helpers: scratch tables on the shared folder, table reading, bounded broadcasts, row identity."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Prefix of the engine's own columns beside a caller's, so that no column of theirs is called the same.
OWN = "_siglume_"
#: Frees the shuffle files of an execution when it ends, instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Arrow batches between JVM and Python workers hold this much, whatever their rows: memory is bounded on both sides.
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def bounded(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, unless the session has a bound of its own."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a local session (driver and executors in one
    process, as in tests) gets a private folder; any other session is refused, since executors would not share one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siglume-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


@contextmanager
def _settings(spark: SparkSession, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, batch: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. Its shuffle
    files go with the write. ``batch`` bounds its Arrow batches otherwise than the session."""
    spark = df.sparkSession
    bounded(spark)
    path = f"{scratch_root(spark)}/siglume/{name}-{uuid.uuid4().hex}"
    with _settings(spark, **{CLEANUP: "true", BATCH_KEY: batch or spark.conf.get(BATCH_KEY)}):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*held) -> None:
    """Deletes tables that ``materialize`` wrote and destroys broadcast variables that nothing reads any more."""
    for x in held:
        if isinstance(x, DataFrame):
            if path := getattr(x, "_scratch", None):
                at = x.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(x.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
        elif x is not None:
            x.destroy()


def settle(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that plans, broadcasts and job records of finished steps go before the next."""
    gc.collect()
    spark._jvm.System.gc()


def per_worker(key, make):
    """One object for each Python worker process, whatever task asks first; the last few keys are kept."""
    import sys
    import types

    held = sys.modules.setdefault("_siglume_held", types.ModuleType("_siglume_held")).__dict__.setdefault("kept", {})
    if key not in held:
        while len(held) >= 4:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]


#: Tables of up to this many bytes, by their count and the width of their rows, are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 8_000_000


def _width(df: DataFrame) -> int:
    """Bytes that a row takes in a hash table, by its schema: long and double columns 8, others 24, and 32 of its own."""
    return 32 + sum(8 if t in ("bigint", "double", "int", "boolean") else 24 for _, t in df.dtypes)


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it is at most ``BROADCAST_BYTES``, by a count."""
    most = BROADCAST_BYTES // _width(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: A bitmap has at most this many bits (32 MB), whatever the data.
BITMAP_BITS = 28


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Bitmap over the low bits of 64-bit hashes (16 bits an id, 32 MB at most), aggregated by the executors; a scan can
    test it before anything is shuffled. A set bit may be another id's: it needs an exact check later."""
    count = max(ids.count(), 1)
    bits = 1 << min(BITMAP_BITS, max(20, (16 * count - 1).bit_length()))
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    maps = ids.select(F.shiftright(place, 15).alias("b"), place.alias("p")).groupBy("b").agg(F.bitmap_construct_agg(F.pmod("p", F.lit(32768))).alias("m"))
    whole = np.zeros((bits >> 15, 4096), dtype=np.uint8)
    for r in maps.toLocalIterator():
        whole[r["b"]] = np.frombuffer(r["m"], dtype=np.uint8)
    return whole.ravel()


def in_bitmap(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``values`` have their bit set."""
    at = (values.view(np.uint64) & np.uint64(len(table) * 8 - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
