"""Cutting lineage in storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``; only where none is set, as in tests, make one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="hunkmill-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the checkpoint folder, so that a lost executor costs no recomputation of what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
