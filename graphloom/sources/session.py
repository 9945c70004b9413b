"""Sessions, and lineage cuts in the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and one machine; on a cluster the session is given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("graphloom")
    for k, v in {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df with a reliable checkpoint in spark.checkpoint.dir, so that a lost executor costs no recomputation.

    Where none is set, a session within one process (as in tests) gets a temporary folder; a cluster gets an error, since
    its executors would write to different disks.
    """
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-checkpoint-"))
    return df.checkpoint(eager=True)
