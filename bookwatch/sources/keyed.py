"""Tables written for lookups by key.

Rows are dealt into folders by a hash of the key, as many as the row count asks
for, and sorted by key inside a file. A lookup names the folder (partition
pruning) and the key (a filter pushed to the scan, which skips row groups by
their bounds): it reads one small file, not the table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a folder, about.
FOLDER_ROWS = 250_000
_FOLDER = re.compile(r"key_folder_of_(\d+)")


def _folder(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(folders)).cast("int")


def write_keyed(df: DataFrame, path: str, key: str, folder_rows: int = FOLDER_ROWS) -> DataFrame:
    """Write ``df`` under ``path`` for ``lookup`` by ``key`` and read it back. Rows
    without a key are written too, and found by a lookup of None."""
    folders = max(1, -(-df.count() // folder_rows))
    name = f"key_folder_of_{folders}"
    (df.withColumn(name, _folder(F.col(key), folders)).repartition(folders, name)
     .sortWithinPartitions(name, key).write.partitionBy(name).parquet(path))
    return df.sparkSession.read.parquet(path).select(*df.columns, name)


def lookup(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of a table written by ``write_keyed`` whose key is ``value``."""
    name = next((c for c in table.columns if _FOLDER.fullmatch(c)), None)
    if name is None:
        raise ValueError("not a table written for lookups by key")
    spark: SparkSession = table.sparkSession
    kind = table.schema[key].dataType
    wanted = F.lit(value).cast(kind)
    folders = int(_FOLDER.fullmatch(name)[1])
    # the folder's number is worked out beforehand, so that the scan is pruned by a literal
    at = spark.range(1).select(_folder(wanted, folders)).first()[0]
    return table.where((F.col(name) == F.lit(at)) & F.col(key).eqNullSafe(wanted)).drop(name)
