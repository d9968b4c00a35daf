"""Helpers that the corpus operators share: tables, shared storage, row ids."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bomlens.errors import EngineError

#: ASCII white space, as the word contracts define it.
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where spark.checkpoint.dir is unset and driver and executors are one process (tests) a folder of its own is set.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise EngineError("no_shared_folder", "spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="bomlens-")
        context.setCheckpointDir(root)
        root = context.getCheckpointDir()
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below shared_root; it is deleted when this process ends."""
    path = f"{shared_root(spark)}/bomlens-{name}-{uuid.uuid4().hex}"
    atexit.register(delete_folder, spark, path)
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM has ended: nothing can be deleted any more
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as it takes to clash with no column of df, whatever their case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def with_row_id(df: DataFrame, name: str = "_rid") -> DataFrame:
    """A number for each row. Only stable once the frame is stored."""
    return df.withColumn(name, F.monotonically_increasing_id())


def crc_mod(column: str, divisor: int):
    """crc32 of the id written as text, modulo divisor; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


#: A list of keys is broadcast up to this length (16 MB of 8-byte keys with their overhead); beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000


def without_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """df without the rows whose key stands in keys; keys are stored and counted to choose the join."""
    found = stored(keys.select(on).distinct(), "keys")
    return df.join(F.broadcast(found) if found.count() <= BROADCAST_KEYS else found, on, "left_anti")


def is_frequent(df: DataFrame, count: str, bound: int):
    """The condition on a count that at most bound rows of df meet, the largest counts: all at or above a step of a scale of 16 steps an octave.

    Only a histogram of a few hundred rows reaches the driver; nothing is sorted.
    """
    step = F.floor(F.log2(count) * 16).cast("int")
    bins = sorted(((r["step"], r["rows"]) for r in df.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    total, least = 0, None
    for at, rows in bins:
        if total + rows > bound:
            break
        total, least = total + rows, at
    return step >= least if least is not None else F.lit(False)


def most_frequent(df: DataFrame, count: str, bound: int) -> DataFrame:
    """The rows of df that is_frequent tells."""
    return df.filter(is_frequent(df, count, bound))


def scans_files(df: DataFrame) -> bool:
    """Whether df only reads, filters and projects files, so that its partitions are the same rows each time."""
    node = df._jdf.queryExecution().optimizedPlan()
    if not node.deterministic():
        return False
    while (name := node.getClass().getSimpleName()) in ("Project", "Filter"):
        node = node.child()
    return name == "LogicalRelation"


#: Numbers of malloc's options for the trim and the map threshold.
_TRIM, _MAP = -1, -3


def released() -> None:
    """Give freed memory of this worker back to the system."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def tidied(run, hold: int | None = None):
    """run for mapInArrow, after which a worker gives freed memory back to the system; workers live on between tasks.

    With hold, malloc keeps freed blocks of up to so many bytes for the next ones while it runs, instead of mapping each anew.
    """

    def wrapped(batches):
        option = getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)
        if hold:
            option(_MAP, hold)
            option(_TRIM, 8 * hold)
        try:
            yield from run(batches)
        finally:
            if hold:
                option(_MAP, 1 << 17)
                option(_TRIM, 1 << 17)
            released()

    return wrapped


def slices(texts, size: int):
    """(start, length) of runs of an Arrow column of texts with about size bytes each."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)) // size
    starts = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]]) if len(ends) else np.empty(0, np.int64)
    return zip(starts.tolist(), np.diff(np.r_[starts, len(ends)]).tolist(), strict=True)


def published(df: DataFrame, name: str) -> str:
    """df, bounded by its caller, as Parquet in the shared folder, for workers to read whole; the path."""
    path = shared_folder(df.sparkSession, name)
    df.coalesce(1).write.parquet(path)
    return path


def read_published(path: str, keys=None, missing_ok: bool = False):
    """The Arrow table at a path of the shared folder, or its rows with some keys; runs on executors."""
    from pyarrow import dataset, fs

    store, inner = (fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")) if path.startswith("file:") or "://" not in path else fs.FileSystem.from_uri(path)
    if missing_ok and store.get_file_info(inner).type == fs.FileType.NotFound:
        return None
    found = dataset.dataset(inner, filesystem=store, format="parquet")
    return found.to_table(columns=["key", "ids"], filter=dataset.field("key").isin(keys)) if keys is not None else found.to_table()
