"""Inventory of log segments in a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.sources.event_text import segment_number


def segments(spark: SparkSession, folder: str, prefix: str, recursive: bool = False) -> DataFrame:
    """``source, name, seq, mtime, bytes`` of the files whose name starts with ``prefix``, unread.

    ``source`` is the path of the folder that holds the file below ``folder`` (or that folder's own name), so
    folders of equal last names are different sources.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", f"{prefix}*")
        .load(folder)
    )
    # Listed paths carry the scheme that ``folder`` may lack, so the folder is found by its own path.
    root = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder).strip("/") + "/"
    own = root.strip("/").rsplit("/", 1)[-1]
    holder = F.regexp_replace(F.substring_index(F.concat(F.lit("/"), "path"), root, -1), "/?[^/]*$", "")
    return files.select(
        F.when(holder == "", F.lit(own)).otherwise(holder).alias("source"),
        F.substring_index("path", "/", -1).alias("name"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("bytes"),
    ).select("source", "name", segment_number(F.col("name")).alias("seq"), "mtime", "bytes")
