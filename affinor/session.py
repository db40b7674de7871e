"""Session defaults and lineage cutting."""
from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "affinor", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators assume; on a cluster the submitted configuration wins."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by spark.checkpoint.dir. A private folder is made only for a local master (tests), where driver
    and executors are one process; any other master without the setting is an error, since executors would not see each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[[^\]]*\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="affinor-ckpt-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (the checkpoint folder of the session)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, **options: object) -> DataFrame:
    """Write the rows to the shared folder and read them back: they survive the loss of any executor, the plan starts
    afresh, and the optimiser knows the size of what it reads. `options` go to the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
