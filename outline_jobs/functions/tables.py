"""Stage tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir.

    Only where a session on one machine has no such setting, as in tests, is a temporary folder made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Inside, a setting of the session has this value; what it was is put back after it."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Shuffle files go as soon as the table made of them is written; else they stay until the driver happens to collect its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CODEC = "zstd"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own: computed once, plans stay short, lost executors cost nothing."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    with setting(spark, _CLEANED, "true"):
        df.write.option("compression", CODEC).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Lets a join on doc_id and more keys use rows that lie together by doc_id alone.
_TOGETHER = "spark.sql.requireAllClusterKeysForCoPartition"


def together(spark: SparkSession):
    """Inside, joins on a key and others take their sides as they lie by that key."""
    return setting(spark, _TOGETHER, "false")


def kept_together(df: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """df as a table of its own whose rows lie together by key, in as many buckets as the session has shuffle partitions.

    What reads it needs no exchange for windows, groups and joins by that key, with or without further keys. The catalog holds the
    table's name only while its layout is read; the files are those of any stage table.
    """
    spark = df.sparkSession
    path, table = stage_path(spark, name), f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    with together(spark), setting(spark, _CLEANED, "true"):
        df.write.format("parquet").option("compression", CODEC).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def once(d: DataFrame, name: str, c: Column) -> DataFrame:
    """d with a column that is computed once for each row, however often it is used and filtered on after that."""
    return d.select("*", F.explode(F.array(c)).alias(name))


def dropped(table: DataFrame) -> None:
    """Deletes the files of a stage table that nothing will read again."""
    spark = table.sparkSession
    for f in {x.rpartition("/")[0] for x in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
