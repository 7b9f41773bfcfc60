"""Streaming queries: the supplied events drained as a stream, results read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from basinframe.catalog.registry import query
from basinframe.operators.contracts import Contract, Provenance, ge, isin, non_null
from basinframe.session import scratch_path
from basinframe.sources.store import LEDGER
from basinframe.streaming import feeds

_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_source(t):
    """The events file as a file stream."""
    return t.spark.readStream.schema(_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(t.folder)


@query("event_stream_dedupe", "SELECT DISTINCT 'http://x/' || (user_id * 7 % 500) AS url FROM events WHERE event_id % 6 <> 0")
def event_stream_dedupe(t):
    k = F.col("event_id")
    stamp = F.when(k % 4 < 3, F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).otherwise("not-a-date")
    raw = event_source(t).select(
        F.when(k % 6 != 0, F.concat(F.lit(" http://x/"), F.col("user_id") * 7 % 500)).otherwise(" ").alias("url"),
        F.lit("T").alias("title"), stamp.alias("seendate"), F.lit("d").alias("domain"),
        F.lit(None).cast("string").alias("sourcecountry"), F.col("ts").cast("timestamp").alias("arrived_at"),
    )
    # The window spans the whole feed, so every link appears once.
    events = feeds.deduplicated(feeds.timed_events(raw), "60 days").select("url")
    out = scratch_path(t.spark, "stream")
    q = (
        events.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return t.spark.read.schema("url string").parquet(f"{out}/table")


@query(
    "contracted_append",
    """SELECT 'good' AS part, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value >= 1e1 UNION ALL
       SELECT 'bad', count(*) FROM events WHERE NOT (event_type IN ('click', 'view', 'purchase') AND value >= 1e1) UNION ALL
       SELECT 'ledger', count(*) FROM events WHERE event_type IN ('click', 'view', 'purchase') AND value >= 1e1""",
)
def contracted_append(t):
    """Good rows, quarantined rows and the ledger's count of the good ones."""
    rule = Contract(
        "events",
        {
            "event_id": non_null("bigint"),
            "event_type": non_null("string", isin(["click", "view", "purchase"])),
            "value": non_null("double", ge(10.0)),
        },
    )
    root = scratch_path(t.spark, "append")
    prov = Provenance("events", dt.datetime(2026, 7, 18, tzinfo=dt.UTC), "https://events.example", "v1")
    feeds.contracted_append(event_source(t), rule, prov, "events", root, f"{root}/_state").awaitTermination()

    def n(path, part, count):
        return t.spark.read.parquet(path).agg(count.alias("n")).select(F.lit(part).alias("part"), "n")

    rows = F.count(F.lit(1))
    return (
        n(f"{root}/events", "good", rows)
        .unionByName(n(f"{root}/events_quarantine", "bad", rows))
        .unionByName(n(f"{root}/{LEDGER}", "ledger", F.sum("rows")))
    )


@query(
    "freshness_stream",
    """WITH n AS (SELECT user_id % 40 AS k, max(ts) AS r FROM events GROUP BY 1)
       SELECT 's' || s_suppkey AS source_id, CASE WHEN r IS NOT NULL AND (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(r)) / 864e8 <= s_suppkey % 3 / 1e1 THEN 'pass' ELSE 'fail' END AS status
       FROM supplier LEFT JOIN n ON n.k = s_suppkey""",
)
def freshness_stream(t):
    registry = t.supplier.select(
        F.concat(F.lit("s"), "s_suppkey").alias("source_id"), (F.col("s_suppkey") % 3 / F.lit(10.0)).alias("sla_days")
    )
    ledger = event_source(t).select(
        F.concat(F.lit("s"), F.col("user_id") % 40).alias("source_id"), F.col("ts").cast("timestamp").alias("retrieved_at")
    )
    out = scratch_path(t.spark, "fresh")
    feeds.freshness_monitor(ledger, registry, out, f"{out}/_state", now="2024-01-30 00:00:00").awaitTermination()
    # Batch 0 carries the whole file; later empty batches change nothing.
    status = t.spark.read.parquet(f"{out}/status")
    newest = status.agg(F.max("batch").alias("batch"))
    return status.join(newest, "batch", "left_semi").select("source_id", "status")
