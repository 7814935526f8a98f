"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule, as a Java and Python regular expression class.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, made longer until no column has them (Spark compares names without case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, a local folder stands in on a local master; a cluster must name one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tallystone-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


#: Removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, path: str) -> None:
    """Append ``df`` to the Parquet table at ``path``; the shuffles that made it go with the query."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode("append").parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for a table in the shared folder. It goes when the driver's JVM ends, or before by ``drop_staged``."""
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    MADE.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs a reread, not a recomputation, and Python
    passes run once however often the table is used.
    """
    path = stage_path(df.sparkSession, name)
    stage(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths of the staged tables of this driver, oldest first.
MADE: list[str] = []


def drop_staged(spark: SparkSession, since: int, keep: DataFrame | None = None) -> None:
    """Delete the tables staged after the first ``since``, but for those that ``keep`` reads. Whatever still reads them fails from then on."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()} if keep is not None else set()
    for path in [p for p in MADE[since:] if p.rsplit("/", 1)[-1] not in kept]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        MADE.remove(path)


#: A key with more than one of so many rows is hot; so at most so many keys are.
HOT_SHARE = 1024


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, spot: Column) -> DataFrame:
    """Equi-join with ``right``, which has one row a key and in ``n`` the key's rows in ``left``; hot keys are salted.

    A hot key's rows are dealt by ``spot`` over as many salts as it has ``1 / HOT_SHARE`` of all rows, and its row
    of ``right`` is copied for each. At most ``HOT_SHARE`` keys can be hot, so their table is broadcast. The sum of ``n`` needs to
    be no more than a bound for the rows of ``left``. Null keys don't match.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    salts = F.ceil(F.col(n) * F.lit(float(HOT_SHARE)) / F.lit(float(max(1, total)))).cast("int")
    salted = right.withColumn("salts__", salts)
    hot = salted.where("salts__ > 1").select(*keys, "salts__")
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("salt__", F.when(F.col("salts__") > 1, F.pmod(F.xxhash64(spot), F.col("salts__"))).otherwise(0).cast("int")).drop("salts__")
    copied = salted.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.col("salts__") - 1))).drop("salts__", n)
    return dealt.join(copied, [*keys, "salt__"]).drop("salt__")


def mapped_file(data: bytes, suffix: str) -> str:
    """A read-only copy of ``data`` in this executor's own temporary folder, to be memory-mapped.

    It is derived from a broadcast, so a new executor makes its own; workers of one
    executor share it, and nothing outside the executor reads it.
    """
    path = os.path.join(tempfile.gettempdir(), f"tallystone-{hashlib.sha256(data).hexdigest()[:24]}{suffix}")
    if not os.path.exists(path):
        handle, part = tempfile.mkstemp(dir=tempfile.gettempdir())
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        os.replace(part, path)
    return path


def rows_of(batches, columns: list[str], size: int = 512):
    """Lists of column values from Arrow batches, at most ``size`` rows at a time, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]
    tidy()


def tidy() -> None:
    """Hand memory that a task has freed back to the system: workers live on, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)
