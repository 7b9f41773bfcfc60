"""Tables on shared storage: versioned Parquet writes and an append-only ledger."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinframe.errors import DataError, TableAbsent
from basinframe.operators.contracts import (
    Contract,
    Provenance,
    attach_provenance,
    content_hash,
    require_rows,
)
from basinframe.session import small_table

LEDGER = "_ledger"
LEDGER_SCHEMA = (
    "source_id string, table string, path string, rows bigint, content_sha256 string, "
    "retrieved_at timestamp, source_url string, transform_version string, written_at timestamp"
)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_with_ledger(
    df: DataFrame, prov: Provenance, table: str, root: str, contract: Contract | None = None
) -> DataFrame:
    """Write a new version of ``table`` and append its ledger row.

    Readers follow the ledger, so a write that dies half-way, or whose rows break
    the contract, is never read. Checks, row count and hash are taken from the
    files just written: the feed is computed once, and tasks that ran twice do
    not count twice.
    """
    spark = df.sparkSession
    path = f"{table}/{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{path}")
    stored = spark.read.schema(df.schema).parquet(f"{root}/{path}")
    try:
        require_rows(stored, prov.source_id)
        if contract is not None:
            contract.enforce(stored)
    except DataError:
        _delete(spark, f"{root}/{path}")
        raise
    entry = content_hash(stored).select(
        F.lit(prov.source_id).alias("source_id"),
        F.lit(table).alias("table"),
        F.lit(path).alias("path"),
        F.col("n_rows").alias("rows"),
        "content_sha256",
        F.lit(prov.retrieved_at).cast("timestamp").alias("retrieved_at"),
        F.lit(prov.source_url).alias("source_url"),
        F.lit(prov.transform_version).alias("transform_version"),
        F.current_timestamp().alias("written_at"),
    )
    entry = small_table(spark, [tuple(entry.first())], LEDGER_SCHEMA)  # the one ledger row
    entry.coalesce(1).write.mode("append").parquet(f"{root}/{LEDGER}")
    return entry


def append_batch(batch: DataFrame, prov: Provenance, table: str, root: str, number: int) -> None:
    """Store one stream batch of ``table`` and append its ledger row.

    Batches of a table share a folder, which the ledger names, so a reader gets them
    all. A batch that is run again overwrites its folder and is entered once.
    """
    spark = batch.sparkSession
    path = f"{root}/{table}/batch={number}"
    batch.write.mode("overwrite").parquet(path)
    version = f"{prov.transform_version}/batch={number}"
    ledger = read_ledger(spark, root).where((F.col("table") == table) & (F.col("transform_version") == version))
    if not ledger.isEmpty():
        return
    entry = content_hash(spark.read.schema(batch.schema).parquet(path)).select(
        F.lit(prov.source_id).alias("source_id"),
        F.lit(table).alias("table"),
        F.lit(table).alias("path"),
        F.col("n_rows").alias("rows"),
        "content_sha256",
        F.lit(prov.retrieved_at).cast("timestamp").alias("retrieved_at"),
        F.lit(prov.source_url).alias("source_url"),
        F.lit(version).alias("transform_version"),
        F.current_timestamp().alias("written_at"),
    )
    entry = small_table(spark, [tuple(entry.first())], LEDGER_SCHEMA)  # the one ledger row
    entry.coalesce(1).write.mode("append").parquet(f"{root}/{LEDGER}")


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, f"{root}/{LEDGER}"):
        return small_table(spark, [], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(f"{root}/{LEDGER}")


def latest_by_table(ledger: DataFrame, seq: str = "written_at") -> DataFrame:
    """Newest entry of every table."""
    rest = [c for c in ledger.columns if c != "table"]
    newest = ledger.groupBy("table").agg(F.max_by(F.struct(*rest), F.col(seq)).alias("e"))
    return newest.select("table", *[F.col(f"e.{c}").alias(c) for c in rest])


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    """Current version of a table, or None when it was never written."""
    entry = latest_by_table(read_ledger(spark, root).where(F.col("table") == table)).first()
    return spark.read.parquet(f"{root}/{entry['path']}") if entry else None


def need_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    df = read_table(spark, root, table)
    if df is None:
        raise TableAbsent(table, "never written")
    return df


def availability(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every wanted table with ``available``; absence is a row, not an omission."""
    return wanted.join(latest_by_table(ledger).select("table", "rows"), "table", "left").select(
        "table", F.col("rows").isNotNull().alias("available"), "rows"
    )


def run_source(
    df: DataFrame, contract: Contract, prov: Provenance, table: str, root: str
) -> DataFrame:
    """Stamp, validate and store one normalised feed; returns its ledger row."""
    stamped = attach_provenance(df, prov)
    return write_with_ledger(stamped, prov, table, root, contract.with_provenance())


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and content hash of each table, as one frame."""
    out = None
    for name in sorted(tables):
        row = content_hash(tables[name]).select(F.lit(name).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def data_mode(ledger: DataFrame, frozen: bool) -> DataFrame:
    """SNAPSHOT when a manifest froze the tables, SHELL when there are none, else LIVE."""
    newest = latest_by_table(ledger)
    return newest.agg(
        F.count(F.lit(1)).alias("tables"), F.max("retrieved_at").alias("newest_retrieved_at")
    ).select(
        F.when(F.lit(frozen), "SNAPSHOT")
        .when(F.col("tables") == 0, "SHELL")
        .otherwise("LIVE")
        .alias("mode"),
        "tables",
        "newest_retrieved_at",
    )


def write_cells(cells: DataFrame, path: str, tile: int = 100) -> None:
    """Raster cells, clustered by tile so that point lookups prune partitions."""
    cells.withColumns(
        {
            "tile_row": (F.col("row") / tile).cast("int"),
            "tile_col": (F.col("col") / tile).cast("int"),
        }
    ).repartition("tile_row", "tile_col").write.mode("overwrite").partitionBy(
        "tile_row", "tile_col"
    ).parquet(path)


def read_cells(spark: SparkSession, path: str, channels: list[str] | None = None) -> DataFrame:
    """Stored cells with their tile; a filter on the tile columns reads those folders only."""
    cells = spark.read.parquet(path)
    return cells.select("row", "col", *channels, "tile_row", "tile_col") if channels else cells


def write_records(df: DataFrame, path: str, columns: dict[str, Column]) -> None:
    """Compact export for a display layer: chosen columns, one JSON row each."""
    df.select(*[c.alias(n) for n, c in columns.items()]).write.mode("overwrite").json(path)
