"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session on one machine (master local) gets a folder of its own where it names none; a cluster
    without a shared folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Bytes of an Arrow batch, where the session keeps Spark's own bound.
ARROW_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, whose session sends small batches to Python from now on. Spark's own bound of 64 MB is held
    several times over (rows, Arrow buffers on both sides, Python objects) by each task."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864", "64MB"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


def materialise(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back, which cuts its lineage. All tables of an
    application lie in one folder of its name, which can go when it has ended."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lectern-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of materialise() once all that reads them is written itself."""
    for df in written:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of steps that are written go now: Spark drops them when the driver finds their
    plans unused, for which it looks every half hour only."""
    for _ in range(2):  # what the first round ends may still hold what the second finds
        gc.collect()
        time.sleep(0.3)  # the JVM hears of what Python dropped a little later
        spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, _UPPER, _UPPER.lower())


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have yet, made from names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


#: A side of at most this many rows, and values where rows hold arrays, is broadcast; beyond, Spark
#: joins by shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_VALUES = 2_000_000


def shuffled(df: DataFrame) -> DataFrame:
    """df marked for a join by shuffle. Spark takes the size of a side from that of its files, times the width of its
    rows: it knows neither how many rows an array yields nor how well a file is packed, and broadcasts, through the
    driver, what is many times its own bound."""
    return df.hint("merge")


def small_side(df: DataFrame, values: str | None = None) -> DataFrame:
    """df (written already, so that counting is cheap) marked for broadcast if it is small, else for a shuffle.
    values: the column of arrays, if it has one, whose elements are counted too."""
    few = df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    if few and values:
        few = (df.agg(F.sum(F.size(values))).first()[0] or 0) <= BROADCAST_VALUES
    return F.broadcast(df) if few else shuffled(df)


def bitmap_slots(hashes: int, least: int = 1 << 17, most: int = 1 << 20) -> int:
    """Longs of a bitmap (1 to 8 MB): so many that at most an eighth of the bits is set, as far as the largest goes."""
    slots = least
    while slots < most and slots * 8 < hashes:
        slots *= 2
    return slots


def _slot(h: Column, slots: int) -> Column:
    return h.bitwiseAND(F.lit(slots - 1)).cast("int")


def _bit(h: Column) -> Column:
    return F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")


def bitmap(hashes: DataFrame, slots: int) -> Column:
    """The hashes (column h) as one array of so many longs, whatever their number; a scalar subquery."""
    one = F.expr("shiftleft(cast(1 as bigint), b)")
    bits = hashes.select(_slot(F.col("h"), slots).alias("s"), _bit(F.col("h")).alias("b")).groupBy("s").agg(F.bit_or(one).alias("bits"))
    every = hashes.sparkSession.range(slots).select(F.col("id").cast("int").alias("s"), F.lit(0).cast("long").alias("bits"))
    dense = bits.union(every).groupBy("s").agg(F.bit_or("bits").alias("bits"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "bits"))), lambda x: x["bits"]).alias("bitmap")).scalar()


def marked(bits: Column, h: Column, slots: int) -> Column:
    """True for every hash in the bitmap, and for a few others."""
    return F.call_function("shiftrightunsigned", F.get(bits, _slot(h, slots)), _bit(h)).bitwiseAND(F.lit(1).cast("long")) == 1
