"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders of local sessions without the setting, by application: Spark lets no session set it once it runs.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a new one for a local session (tests); on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.conf.get("spark.app.id")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        at = _own[app]
    return at.rstrip("/")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df with all rows of a key in one task, for what passes over a key's rows in order.

    Dealt by a hash of the keys, not by these themselves: Spark leaves a shuffle out that repeats one before it, and where
    a union's parts were dealt by the keys already it then puts the tasks of each part together in another way.
    """
    return df.repartition(F.xxhash64(*keys))


def tasks(spark: SparkSession) -> int:
    """How many tasks a large shuffle is dealt over: the session's number, stated in repartition, so that Spark puts none of
    them together. Left to itself it goes by compressed bytes, of which 64 MB may be gigabytes of rows to sort."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once as Parquet, with options of its writer, in the shared folder and return the table read back.

    The lineage ends there, the result survives lost executors, and later uses do not compute it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
