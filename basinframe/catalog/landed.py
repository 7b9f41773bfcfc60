"""Queries over landed files: documents written from the tables, then read and loaded by their feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.catalog.registry import day, query
from basinframe.catalog.shapes import lat_of, lat_sql, lon_of, lon_sql
from basinframe.functions import codes
from basinframe.session import scratch_path
from basinframe.sources import landed

#: Records of one landed document, and the request whose series the prices are.
_PER_FILE = 20_000
_SPOT_ID, _SPOT_METRIC = next(iter(codes.SPOT_METRICS.items()))


def _land(records: DataFrame, head: str, tail: str, label: str) -> str:
    """Write JSON documents of records (k, value), ``_PER_FILE`` keys each; the folder's path.

    A document ends with a null in place of a record, which readers pass over.
    """
    doc = F.floor(F.col("k") / _PER_FILE).alias("doc")
    body = records.select(doc, F.lit(1).alias("ord"), "k", F.concat("value", F.lit(",")).alias("value"))
    ends = F.array(F.struct(F.lit(0), F.lit(head)), F.struct(F.lit(2), F.lit("null" + tail)))
    ends = records.select(doc).distinct().select("doc", F.explode(ends).alias("e"))
    rows = body.unionByName(ends.select("doc", F.col("e.col1").alias("ord"), F.lit(0).alias("k"), F.col("e.col2").alias("value")))
    path = scratch_path(records.sparkSession, label)
    sorted_ = rows.repartition("doc").sortWithinPartitions("doc", "ord", "k").select("doc", "value")
    sorted_.write.partitionBy("doc").text(path)
    return path


@query(
    "price_observations_file",
    f"""SELECT strftime(DATE '1970-01-01' + CAST(c_custkey AS INT), '%Y-%m-%d') AS date, '{_SPOT_ID}' AS series_id,
        '{_SPOT_METRIC}' AS metric, c_acctbal AS value FROM customer WHERE c_custkey % 10 <> 0""",
)
def price_observations_file(t):
    """One series, one observation per customer; ``.`` marks a missing value."""
    k = F.col("c_custkey")
    value = F.when(k % 10 == 0, ".").otherwise(F.col("c_acctbal").cast("string"))
    date = day(F.date_add(F.lit("1970-01-01").cast("date"), k.cast("int")))
    records = t.customer.select(k.alias("k"), F.to_json(F.struct(date.alias("date"), value.alias("value"))).alias("value"))
    path = _land(records, '{"units":"x","observations":[', "]}", "prices")
    out = landed.SPOT.load(t.spark, path, {"series_id": _SPOT_ID})
    return out.withColumn("date", day("date"))


@query(
    "event_feed_file",
    f"""WITH raw AS (
          SELECT 'doc=' || (event_id // {_PER_FILE}) || '/' AS file, event_id AS pos, 'http://x/' || (user_id * 7 % 500) AS url,
                 CASE WHEN event_id % 5 = 0 THEN '' ELSE 'T{{' || event_id || '}}' END AS title
          FROM events WHERE event_id % 6 <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY file, pos) AS n FROM raw)
        SELECT url, title, 'd' || (pos % 3) AS domain FROM r WHERE n = 1""",
)
def event_feed_file(t):
    """The first article of each link, by file and place in the file; braces in titles."""
    k = F.col("event_id")
    article = F.struct(
        F.when(k % 6 != 0, F.concat(F.lit(" http://x/"), F.col("user_id") * 7 % 500)).otherwise("  ").alias("url"),
        F.when(k % 5 == 0, " ").otherwise(F.concat(F.lit("T{"), k, F.lit("}"))).alias("title"),
        F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"),
        F.concat(F.lit("d"), k % 3).alias("domain"),
    )
    path = _land(t.events.select(k.alias("k"), F.to_json(article).alias("value")), '{"articles":[', "]}", "articles")
    out = landed.EVENTS.load(t.spark, path)
    return out.select("url", F.coalesce("title", F.lit("")).alias("title"), "domain")


@query(
    "field_points_file",
    f"""SELECT DISTINCT 'gem_goget:' || (s_suppkey // 2) AS field_id, 'Field ' || (s_suppkey // 2) AS name,
        CASE WHEN s_suppkey // 2 % 3 = 0 THEN -1 ELSE CAST(1950 + s_suppkey // 2 % 60 AS INT) END AS discovery_year,
        {lat_sql('s_suppkey // 2', 6151)} AS lat, {lon_sql('s_suppkey // 2', 15013)} AS lon FROM supplier""",
)
def field_points_file(t):
    """A feature collection, two suppliers a field; identical features collapse."""
    k = F.floor(F.col("s_suppkey") / 2).cast("long")
    props = F.struct(
        k.cast("string").alias("project-id"),
        F.concat(F.lit("Field "), k).alias("name"),
        F.lit("X").alias("country-area1"),
        F.lit(codes.FIELD_STATUSES[0]).alias("status"),
        F.when(k % 3 == 0, " ").otherwise((k % 60 + 1950).cast("string")).alias("discovery-year"),
    )
    point = F.struct(F.lit("Point").alias("type"), F.array(lon_of(k, 15013), lat_of(k, 6151)).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), props.alias("properties"), point.alias("geometry")))
    head = '{"type":"FeatureCollection","crs":{"properties":{"name":"x"}},"features":['
    path = _land(t.supplier.select(F.col("s_suppkey").alias("k"), feature.alias("value")), head, "]}", "fields")
    out = landed.FIELDS.load(t.spark, path)
    return out.select("field_id", "name", F.coalesce("discovery_year", F.lit(-1)).alias("discovery_year"), "lat", "lon")
