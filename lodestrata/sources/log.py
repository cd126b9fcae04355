"""Append-only logs of JSON lines in which the last line of a key stands, over any number of files.

An append is an epoch: a folder of its own, written whole, so that an append that is tried again replaces
itself and doubles nothing. Lines carry their place in the epoch. Files that others added to the log are read by name and place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.ranking import numbered
from lodestrata.functions.text import parent

#: The place of a line in its epoch.
PLACE = "_place"


def epochs(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the epochs of a log, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    names = (f.getPath().getName() for f in store.listStatus(place))
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"epoch=(\d+)", n)))


def append_lines(rows: DataFrame, path: str, order: list, epoch: int | None = None) -> int:
    """Add ``rows`` as lines, in ``order`` (columns that leave no ties), and give the epoch's number.

    Without ``epoch`` it is the next one. A writer that may be tried again gives its own (the batch number of a stream): a
    later try then replaces what the earlier one wrote.
    """
    if epoch is None:
        epoch = max(epochs(rows.sparkSession, path), default=0) + 1
    numbered(rows, PLACE, order).write.mode("overwrite").json(f"{path}/epoch={epoch:012d}")
    return epoch


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line map<string,string>, at): the lines that are JSON objects, with what they are ordered by; other lines are skipped.

    ``at`` is epoch, place in the epoch, then file, block and place in the block, for lines that don't carry theirs.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = text.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    parsed = raw.withColumn("line", F.from_json("value", "map<string,string>")).where("line is not null and size(line) > 0")
    place = F.coalesce(F.try_element_at("line", F.lit(PLACE)).cast("long"), F.lit(0))
    return parsed.select("line", F.struct(parent(F.col("file_path")).alias("folder"), place.alias("place"), "file_path", "file_block_start", "id").alias("at"))


def last_of_key(lines: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of the last of ``read_lines`` that has both, for each key; an aggregate that is combined before its exchange."""
    of = lambda name: F.try_element_at("line", F.lit(name))
    has: Column = F.map_contains_key("line", F.lit(key)) & F.map_contains_key("line", F.lit(value))
    own = lines.where(has).select(of(key).alias("key"), of(value).alias("value"), "at").where("key is not null")
    return own.groupBy("key").agg(F.max_by(F.struct("value"), "at").alias("last")).select("key", F.col("last.value").alias("value"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, summary) of a cache of summaries: the last good line of a key stands."""
    return last_of_key(read_lines(spark, path), "key", "summary").withColumnRenamed("value", "summary")
