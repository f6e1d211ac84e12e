"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "recallflow", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect.

    The master is left to spark-submit unless given, so the same code runs on a
    cluster and in ``local[n]`` tests.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    _checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a text table into as many partitions as the setting asks for.

    Text functions are CPU-bound and a small file may be one row group, thus one task; the
    bench asks for its cores. Unset, the default, nothing is added: a large table already
    has more splits than a cluster has cores.
    """
    n = df.sparkSession.conf.get("spark.recallflow.textPartitions", None)
    return df.repartition(int(n), key) if n else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the files.

    Iterative operators call this once per round: the plan stays short and a lost
    executor costs a re-read, not a replay of every earlier round.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the checkpoint folder as Parquet and read it from there.

    Against :func:`cut` the plan runs once, not twice, and repeated names, tokens and ids
    take a tenth of the disk. Partitioning and order of the rows are not kept.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    # Small row groups: a task buffers one of them for each file it writes.
    df.write.option("parquet.block.size", 32 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
