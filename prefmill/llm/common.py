"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Whether shuffle files are removed when the query that wrote them ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of shuffles that adaptive execution gives to a task.
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
#: On local disks: without a file of checksums beside each file.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only on a local master that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="prefmill-"))
    return sc.getCheckpointDir()


def remove_at_exit(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def cut_lineage(df: DataFrame, free: bool = False, few: bool = False) -> DataFrame:
    """The rows as a table written to the shared folder.

    Unlike a checkpoint's, its statistics are those of its files: estimates that
    are handed on would multiply in loops, and Spark broadcasts it in a join only where its
    bytes are under spark.sql.autoBroadcastJoinThreshold. The folder is removed at exit.
    With ``free`` the shuffle files that led to it go at once; else they stay until the driver happens to collect its garbage.
    With ``few`` tasks get 32 MB of shuffles or more where the session has less, and checksum files are left out: on a local disk Hadoop forks a chmod for
    every file and folder that a task makes, and until that has begun it counts as a second JVM to whoever sums up the memory of processes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/prefmill-{uuid.uuid4().hex}"
    put = {FREE: "true" if free else spark.conf.get(FREE, None) or "false"}
    if few:
        size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        put[ADVISED] = max(spark.conf.get(ADVISED), "32m", key=size)
    old = {k: spark.conf.get(k, None) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        df.write.options(**PLAIN if few else {}).parquet(path)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators over all columns of their first argument: their own columns begin with _, so input columns that do are called otherwise while they run."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        taken = {c.lower() for c in docs.columns}
        names: dict[str, str] = {}
        for c in docs.columns:
            if c.startswith("_"):
                new = f"own{c}"
                while new.lower() in taken:
                    new = "x" + new
                taken.add(new.lower())
                names[c] = new
        out = operator(docs.withColumnsRenamed(names), *args, **kwargs)
        return out.withColumnsRenamed({v: k for k, v in names.items()})

    return run


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds of texts at once; a longer text is a batch of its own. Workers look for this package where the driver has it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once for all of its uses in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words separated by ASCII white space; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def text_key(text: Column) -> Column:
    """64-bit key of a text. With doc_id it tells rows apart; equal rows share it and get equal results."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def salted_join(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, how: str = "inner", share: int = 10_000, salts: int = 64) -> DataFrame:
    """Joins on ``key`` (one column or several), which is unique in ``right`` and held by ``weight`` rows of ``left``.

    A key with over 1/``share`` of all left rows is hot; there are fewer than
    ``share`` of them, whatever the input, so the hot list is safe to
    broadcast. Hot keys are spread over ``salts`` tasks. ``right`` has to be
    cheap to read again (a checkpoint).
    """
    keys = [key] if isinstance(key, str) else key
    total = right.agg(F.sum(weight)).first()[0] or 0
    many = (F.col(weight) > total / share) & (F.col(weight) > 2_000)
    hot = F.broadcast(right.filter(many).select(*keys, F.lit(True).alias("_hot")))
    own = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")  # of the row itself, so a task that runs again deals as before
    left = left.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), own).otherwise(0)).drop("_hot")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(many, salts).otherwise(1) - 1)))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
