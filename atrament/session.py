"""Session helpers: reading tables, the shared folder for cut lineage, checked broadcasts, salting."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows that a side may hold to be broadcast; counted before every broadcast.
BROADCAST_ROWS = 500_000
#: Copies of the small side, and salts of the large side, in a join on skewed keys.
SALTS = 16


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application; they need no path to it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="atrament-code-"), "atrament.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(d, name), os.path.join("atrament", os.path.relpath(os.path.join(d, name), here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Unset, a local master gets a folder of its own; a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="atrament-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables written to the shared folder: they cut the lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._atrament_path = path
        return out

    def count(self, df: DataFrame) -> tuple[DataFrame, int]:
        """A kept table and its rows, counted while it is written."""
        seen = Observation()
        out = self.keep(df.observe(seen, F.count(F.lit(1)).alias("n")))
        return out, seen.get["n"]

    def release(self) -> None:
        """Lets the driver see that shuffles replaced by kept tables are no longer used, so that their files go."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Removes a kept table that no later plan reads."""
        path = getattr(df, "_atrament_path", None)
        if path:
            fs, p = _hadoop_path(self.spark, path)
            fs.delete(p, True)


def lookup(large: DataFrame, small: DataFrame, key: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """``large`` with the columns of ``small`` (one row per key). A small side is broadcast once its rows are counted;
    else the large side is salted, so that a key with a third of all rows is spread over SALTS tasks."""
    n = small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        return large.join(F.broadcast(small), key, how)
    salted = large.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def running_total(df: DataFrame, order: list[Column], weight: str, out: str, scratch: Scratch, parts: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over all rows before this one in ``order`` (which must be total).
    Range partitions are summed first; only one row per partition is summed in one place."""
    from pyspark.sql import Window

    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.keep(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inner = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn(out, F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .join(F.broadcast(before), "_part")
        .withColumn(out, F.col(out) + F.col("_before"))
        .drop("_part", "_before")
    )


def numbered(df: DataFrame, order: list[Column], out: str, scratch: Scratch) -> DataFrame:
    """Adds ``out``: the place of each row in a total order, from 1, without ordering all rows in one task."""
    return running_total(df.withColumn("_one", F.lit(1)), order, "_one", out, scratch).drop("_one").withColumn(out, F.col(out) + 1)
