"""Session settings and durable cut points.

Spark decides every physical strategy; the library only sets what a shared
cluster job needs: adaptive execution with skew splitting, UTC, Arrow.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("plotline")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "16g")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores where the scan has too few splits to use them.

    A text file of one row group is one task however long its texts take. A scan
    with more splits than twice the cores is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 2 * cores:
        return df
    return df.repartition(cores, key)


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in spark.checkpoint.dir.

    A local session (tests, the benchmark), where driver and executor are one process,
    gets one of its own if none is named; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is not None:
        return named
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_FOLDERS[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write a frame once and go on from the written table.

    Used where one result feeds several branches: lineage ends here, the work
    above is done once, and a lost executor costs no recomputation of it.
    """
    spark = df.sparkSession
    table = f"{shared_folder(spark)}/plotline-{uuid.uuid4().hex}"
    df.write.parquet(table)
    return spark.read.schema(df.schema).parquet(table)
