import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from atrament.session import ship

    ship(s)
    return s


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def scratch(spark):
    from atrament.session import Scratch

    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    """All tables without rows, each with an extra column of a name that plans use inside."""
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("empty")
    for name in os.listdir(DATA):
        df = spark.read.parquet(f"{DATA}/{name}").limit(0)
        df.withColumn("n" if "n" not in df.columns else "n_", F.lit("x")).write.parquet(str(root / name))
    return str(root)


@pytest.fixture(scope="session")
def nulls(spark, tmp_path_factory):
    """All tables with every second row null in all columns but the first, all rows twice, and extra columns."""
    from pyspark.sql import functions as F

    root = tmp_path_factory.mktemp("nulls")
    for name in os.listdir(DATA):
        df = spark.read.parquet(f"{DATA}/{name}")
        key = df.columns[0]
        odd = F.pmod(F.xxhash64(key), F.lit(2)) == 1
        df = df.select(key, *[F.when(odd, F.col(c)).alias(c) for c in df.columns[1:]])
        df = df.union(df).union(df.limit(1).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes]))
        df.withColumns({c: F.lit("x") for c in ("key", "root", "cls", "word", "label") if c not in df.columns}).write.parquet(str(root / name))
    return str(root)
