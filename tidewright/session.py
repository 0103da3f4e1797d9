"""Session helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; in local mode a temporary one if none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


#: Within a checkpoint joins broadcast by what a shuffle has measured alone: sizes guessed from the bytes of compressed files
#: would take tables of hundreds of MB through the driver.
MEASURED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "2m"}


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder of the cluster."""
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = {name: conf.get(name, None) for name in MEASURED}
    for name, value in MEASURED.items():
        conf.set(name, value)
    try:
        return df.select("*").checkpoint()  # a new frame: it is planned under the settings
    finally:
        for name, value in before.items():
            if value is None:
                conf.unset(name)
            else:
                conf.set(name, value)
