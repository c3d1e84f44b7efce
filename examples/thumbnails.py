"""Use from outside: thumbnails of a folder of images as PNG files, with the reasons for those that were refused."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelframe.operators.probe import decode, encode
from pixelframe.sources.files import image_files, write_artifacts


def thumbnails(spark: SparkSession, source: str, target: str, side: int = 128) -> DataFrame:
    """Writes ``<name>.png`` for every image that decodes; gives path and failure of all."""
    images = image_files(spark, source, cap=64 << 20)
    coded = encode(decode(images, "path", (side, side)), "path", background=(255, 255, 255))
    named = coded.withColumn("file", F.concat(F.regexp_extract("path", r"([^/]+)$", 1), F.lit(".png")))
    write_artifacts(named.where("failure IS NULL"), target)
    return coded.select("path", "failure")


if __name__ == "__main__":
    thumbnails(SparkSession.builder.getOrCreate(), sys.argv[1], sys.argv[2]).show(truncate=False)
