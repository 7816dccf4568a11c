"""Session helpers: a default session for tests and scripts, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lodegraph", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings the engine expects; settings of a running session are kept."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (a local test) a folder on this machine is chosen and set.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf = os.path.join(tempfile.gettempdir(), f"lodegraph-checkpoints-{os.getpid()}")
    spark.sparkContext.setCheckpointDir(conf)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def cut_in_loop(df: DataFrame) -> DataFrame:
    """As ``cut``, for results that the next round of a loop reads.

    A checkpoint keeps the estimated size of the plan it cuts. A join's estimate is the product of its sides', so in a
    loop its digits double with every round until planning takes longer than the work. The rows are read back as a plan
    of their own, without estimates.
    """
    c = cut(df)
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(c._jdf.queryExecution().toRdd(), c._jdf.schema(), False), spark)
