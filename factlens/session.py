"""Session construction and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, partitions: int | None = None, app: str = "factlens", memory: str = "8g") -> SparkSession:
    """A session with adaptive execution, UTC and a quiet log; `master` defaults to local[*]."""
    cores = os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(master or "local[*]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can read, from `spark.checkpoint.dir`.

    Only where a local session names none (a test), a temporary folder is set; it is deleted when the process ends. On a cluster a folder must be named.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = getattr(spark, "_factlens_shared", None)
        if conf is None:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
            conf = tempfile.mkdtemp(prefix="factlens-")
            atexit.register(shutil.rmtree, conf, ignore_errors=True)
            spark._factlens_shared = conf
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """`checkpointed`, and without the estimated size: joins multiply it, so over the rounds of a loop the number itself outgrows the driver."""
    spark = df.sparkSession
    j = checkpointed(df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(j.javaRDD(), j.schema()), spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: compressed, reliable, and shared by several readers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a catalogue folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
