"""Session helpers: configuration for tests and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_DIR_KEY = "spark.checkpoint.dir"


def local_session(cores: str = "8", name: str = "basinframe", **extra: str) -> SparkSession:
    """Session for tests and the bench. A cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local master may fall back to a temporary folder; elsewhere a
    machine-local folder would be lost with its machine.
    """
    path = spark.conf.get(_DIR_KEY, None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{_DIR_KEY} must name a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def job_dir(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/job-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{job_dir(spark)}/{label}-{uuid.uuid4().hex}"


def discard_scratch(spark: SparkSession) -> None:
    """Remove this application's intermediate tables. Call it when a job's results are
    written; DataFrames that still read them are then gone too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(job_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a file read and not a rerun of
    everything upstream, and fixes the rows two later branches both build on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: Sequence[Sequence], ddl: str) -> DataFrame:
    """A constant table whose size the optimizer knows, so that a join with it is
    planned as a broadcast only while it is small."""
    schema = StructType.fromDDL(ddl)
    arrow = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)]
    return spark.createDataFrame(pa.table(arrays, schema=arrow), schema)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
