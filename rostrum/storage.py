"""Results kept in the folder that the driver and all executors share, so that a lost executor loses none."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """Computed once, kept under ``spark.checkpoint.dir``, without its lineage; a temporary folder only where that is unset on one machine.

    What is kept there belongs to whoever owns the folder: a result is lazy and may read it long after its query returned.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = context.getConf().get("spark.checkpoint.dir")
        if not root and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="rostrum-"))
    return df.checkpoint(eager=True)
