"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def held(frame: DataFrame) -> DataFrame:
    """``frame`` as written to the shared folder, so that it is computed once and survives lost executors."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = frame.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + os.path.join(tempfile.gettempdir(), "pixelframe-shared"))
    return frame.checkpoint()
