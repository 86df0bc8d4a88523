"""Cutting lineage through the shared folder of the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to ``spark.checkpoint.dir``, which all executors share.

    Executors can be lost afterwards: the rows are read from the folder again. Only
    on one machine without such a folder, as in tests, one of its own is set; a cluster
    must name it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="quire-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
