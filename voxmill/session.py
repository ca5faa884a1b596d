"""Session settings shared by tests, the bench and stand-alone runs, and the few helpers that touch storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; used where no session is handed in."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that `spark.checkpoint.dir` names, set as the session's.

    Where that is unset a local session, as in tests, gets a temporary folder, deleted at the end; a cluster without
    it is an error, as its nodes would each write to their own disk.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "")
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return named or have.get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
    if not named:
        named = tempfile.mkdtemp(prefix="voxmill-ckpt-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return named


def shared_folder(spark: SparkSession) -> str:
    """A new folder for written tables beside the checkpoints."""
    return f"{checkpoint_folder(spark).rstrip('/')}/voxmill-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` through a reliable checkpoint in the shared folder; its files survive the loss of any executor."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
