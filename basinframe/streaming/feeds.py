"""Feeds as Structured Streaming: deduplicated events, contracted appends, freshness.

State lives only in the event and freshness streams; a watermark bounds the first
and the number of sources the second. Checkpoints go to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from basinframe.operators.contracts import Contract, Provenance
from basinframe.operators.series import freshness
from basinframe.sources.events import clean_events
from basinframe.sources.store import append_batch, exists

ARRIVAL = "arrived_at"


def timed_events(raw: DataFrame) -> DataFrame:
    """Cleaned raw events with ``event_time``; ``raw`` carries ``arrived_at``.

    An event without a readable time of its own takes the time it arrived, or it
    would never leave the state.
    """
    stamped = raw.withColumns({"file": F.col(ARRIVAL).cast("string"), "pos": F.lit(0)})
    events = clean_events(stamped).withColumn(
        "event_time", F.coalesce("seen_at", F.col("file").cast("timestamp"))
    )
    return events.drop("file", "pos")


def deduplicated(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per link within the watermark."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["url"])


def _seen(spark, root: str, table: str, batch: DataFrame, number: int) -> DataFrame | None:
    """Rows of the earlier batches; a batch that runs again does not see itself."""
    if not exists(spark, f"{root}/{table}"):
        return None
    schema = StructType([*batch.schema.fields, StructField("batch", IntegerType())])
    kept = spark.read.schema(schema).parquet(f"{root}/{table}")
    return kept.where(F.col("batch") < number)


def contracted_append(
    stream: DataFrame,
    contract: Contract,
    prov: Provenance,
    table: str,
    root: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Per micro-batch: good rows to the table, bad rows to quarantine, one ledger row.

    A key of the contract holds over all batches: a row whose key is already stored goes
    to quarantine. Every batch writes to folders named by its number and overwrites them,
    so a batch that is run again after a failure leaves one copy. ``trigger`` is passed to
    the stream, ``availableNow=True`` without one.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            good, bad = contract.split(batch)
            earlier = _seen(spark, root, table, batch, number) if contract.unique else None
            if earlier is not None:
                key = list(contract.unique)
                again = good.join(earlier.select(*key).distinct(), key, "left_semi")
                why = F.array(F.lit("unique:" + ",".join(key)))
                bad = bad.unionByName(again.withColumn("failed_checks", why))
                good = good.join(earlier.select(*key), key, "left_anti").select(*batch.columns)
            bad.write.mode("overwrite").parquet(f"{root}/{table}_quarantine/batch={number}")
            append_batch(good, prov, table, root, number)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def newest_arrivals(ledger: DataFrame) -> DataFrame:
    """Newest arrival per source, kept up to date (one state row per source)."""
    return ledger.groupBy("source_id").agg(F.max("retrieved_at").alias("retrieved_at"))


def freshness_monitor(
    ledger: DataFrame,
    registry: DataFrame,
    path: str,
    checkpoint: str,
    now: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Status of every registered source after each micro-batch, written to ``path``.

    Update mode sends only changed sources; they are merged with the arrivals that the
    last batch wrote, one row per source, and never with older files. A running monitor
    takes the time of each batch, unless ``now`` fixes it.
    """

    def report(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen, before = batch, f"{path}/arrivals/batch={number - 1}"
        if number and exists(spark, before):
            seen = newest_arrivals(batch.unionByName(spark.read.schema(batch.schema).parquet(before)))
        own = f"{path}/arrivals/batch={number}"
        seen.write.mode("overwrite").parquet(own)
        at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        status = freshness(spark.read.schema(batch.schema).parquet(own), registry, at)
        status.write.mode("overwrite").parquet(f"{path}/status/batch={number}")

    return (
        newest_arrivals(ledger)
        .writeStream.outputMode("update")
        .foreachBatch(report)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
