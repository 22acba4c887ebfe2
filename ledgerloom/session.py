"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at every size. Numbers of partitions follow the data through adaptive execution.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("ledgerloom")
    for key, value in (DEFAULTS | {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"} | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir if the cluster names one.

    Only a local master, where every task runs on this machine, gets a temporary folder instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_ROOTS: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def clear() -> None:
    """Remove all intermediate tables of this process, whose results can no longer be read: at its end, or when called."""
    while _ROOTS:
        try:
            _remove(*_ROOTS.pop())
        except Exception:  # the session has ended already
            return


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of tables that nothing holds any more; else they stay until the driver needs memory."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Intermediate tables of one operator, removable one by one as soon as nothing reads them; what is left goes when the
    driver's process ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"
        _ROOTS.append((spark, self.root))

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def append(self, df: DataFrame, name: str, part: str, value: int) -> tuple[DataFrame, DataFrame]:
        """Add df to a table as the rows of part = value; those rows alone, and the whole table with the part's column.

        The whole is one scan however many parts it has, so that each round of an iteration runs the plan of the last one.
        """
        folder = f"{self.root}/{name}"
        df.write.parquet(f"{folder}/{part}={value}")
        read = self.spark.read.schema(df.schema)
        whole = self.spark.read.schema(f"{df.schema.toDDL()}, `{part}` int").parquet(folder)
        return read.parquet(f"{folder}/{part}={value}"), whole

    def drop(self, name: str) -> None:
        _remove(self.spark, f"{self.root}/{name}")
