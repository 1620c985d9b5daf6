"""A plan's rows written once where all executors can read them, for those that are read several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in the folder that ``spark.checkpoint.dir`` names; its lineage ends there.

    Only in local mode an unset name gives a temporary folder of our own, deleted at exit; elsewhere it is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="spark-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return df.checkpoint()
