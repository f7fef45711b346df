"""What every operator needs of the session: tables, shared checkpoints, size-checked lookups."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A Parquet table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: ``spark.checkpoint.dir`` of the session.

    Only a local session, as in tests, gets a folder of its own where the setting is missing; on a
    cluster a machine-local folder would be lost with its machine, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    have = sc.getCheckpointDir()
    if have:
        return have
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="wardstream-")
    sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """``df`` computed once and read from the shared folder from then on (lineage is cut)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_TABLES: list[str] = []


def table_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the shared folder; :func:`release` deletes what was written there."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    return path


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once to the shared folder and read from there: lineage is cut, columns are pruned when it is read, and the planner knows its size."""
    path = table_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables that this process has written; results that still read them can't be computed any more. Returns how many there were."""
    n, conf = 0, spark.sparkContext._jsc.hadoopConfiguration()
    while _TABLES:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that must be small; more than ``most`` rows are an error, never cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; raise the limit knowingly")
    return rows


def one_scan(df: DataFrame, structs: list) -> DataFrame:
    """Several output rows per input row from a single scan."""
    return df.select(F.inline(F.array(*structs)))
