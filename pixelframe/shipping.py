"""Makes the package importable where Python operators run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch of a session without bounds of its own: its rows may hold whole pictures.
_BOUNDS = (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "512"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "16m"))


def spread(rows: DataFrame, *by: Column) -> DataFrame:
    """``rows`` dealt over a few tasks a core: a small file is one task's, however much Python has to do for each of its rows. Rows equal in ``by`` go to one task, whose worker makes what they share once."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's code to the executors, once for each application, and bound Arrow batches; Python operators call it first."""
    for name, default, bound in _BOUNDS:
        if spark.conf.get(name) == default:
            spark.conf.set(name, bound)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="pixelframe-")) / "pixelframe_code.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted((root / "pixelframe").rglob("*.py")):
                archive.write(source, source.relative_to(root).as_posix())
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
