"""URL filters against dated lists: validity intervals and an as-of lookup per capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basinframe.operators.ordered import prefix


def host_of(url: str | Column) -> Column:
    """Host of a URL in lower case, without user, port and a final dot; null if it has none."""
    c = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals from dated entries (kind, value, listed_on, action).

    An 'add' holds from its date until the key's next entry, open-ended after the last; of
    an 'add' and a 'remove' on one date the removal counts. Entries with a null are ignored,
    repeated ones count once, so a key has at most two rows per date in its window.
    """
    given = entries.select("kind", F.lower("value").alias("value"), "listed_on", "action").dropna().distinct()
    after = W.partitionBy("kind", "value").orderBy("listed_on", "action")
    return (
        given.withColumn("until", F.lead("listed_on").over(after))
        .where("action = 'add' and (until is null or until > listed_on)")
        .select("kind", "value", F.col("listed_on").alias("since"), "until")
    )


def listing_keys(host: str | Column) -> Column:
    """What may list a host: the host itself, and it and all domains above it."""
    host = F.col(host) if isinstance(host, str) else host
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("value")))
    return F.concat(own, F.transform(above, lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("value"))))


def active_entries(wanted: DataFrame, spans: DataFrame) -> DataFrame:
    """As-of join: the rows (kind, value, at) of ``wanted`` that lie in an interval of ``spans``.

    Interval starts and wanted times are one sequence, sorted by key and time; each time
    takes the last interval that started by then, which is the only one it can lie in, as
    intervals of a key are disjoint. The sequence is cut by ranges of (key, time) and the
    last start is carried over the cuts, so neither a host that most captures share nor a
    long history is one task or one row. ``wanted`` has distinct rows.
    """
    starts = spans.select(
        "kind",
        "value",
        F.col("since").cast("timestamp").alias("at"),
        F.lit(0).alias("turn"),
        F.struct(F.col("since").cast("timestamp").alias("since"), F.col("until").cast("timestamp").alias("until")).alias("span"),
    )
    listed = wanted.join(spans.select("kind", "value").distinct(), ["kind", "value"])
    times = listed.select("kind", "value", "at", F.lit(1).alias("turn"), F.lit(None).cast(starts.schema["span"].dataType).alias("span"))
    found = prefix(starts.unionByName(times), ["kind", "value"], ["at", "turn"], maxes={"last": "span"}, label="listings")
    open_ = F.col("last.until").isNull() | (F.col("at") < F.col("last.until"))
    return found.where(F.col("turn") == 1).where(F.col("last").isNotNull() & open_).select("kind", "value", "at")


def filter_urls(captures: DataFrame, entries: DataFrame, url_col: str = "url", at_col: str = "fetched_on") -> DataFrame:
    """Evaluate every capture against the entries active when it was fetched.

    ``entries``: ``kind`` ('host': that host; 'domain': that host and all below it),
    ``value``, ``listed_on``, ``action`` ('add' or 'remove'). Adds ``host``, ``n_active``
    (entries active for the capture), ``rule`` (the first of them as kind:value, null if
    none) and ``blocked`` to the captures. Their other columns stay, whatever their names;
    columns of these four names are replaced.

    Captures of one host and time are judged once, by an as-of join of their keys with the
    intervals of the list (:func:`active_entries`), and look the verdict up. A null or
    hostless URL and a null time match nothing; repeated captures repeat; of several
    entries of one day the removal counts; empty lists block nothing, however long a URL.
    """
    mine = ("host", "n_active", "rule", "blocked")
    rows = captures.select(
        F.struct(*(F.col(f"`{c}`") for c in captures.columns)).alias("own"),
        host_of(F.col(f"`{url_col}`")).alias("host"),
        F.col(f"`{at_col}`").cast("timestamp").alias("at"),
    )
    seen = rows.where("host is not null and at is not null").select("host", "at").distinct()
    keys = seen.select("host", "at", F.explode(listing_keys("host")).alias("key")).select("host", "at", "key.*")
    active = active_entries(keys.select("kind", "value", "at").distinct(), validity(entries))
    verdicts = (
        keys.join(active, ["kind", "value", "at"])
        .groupBy("host", "at")
        .agg(F.count("*").alias("n_active"), F.min(F.concat_ws(":", "kind", "value")).alias("rule"))
    )
    kept = [F.col("own").getField(c).alias(c) for c in captures.columns if c not in mine]
    n_active = F.coalesce("n_active", F.lit(0))
    return rows.join(verdicts, ["host", "at"], "left").select(
        *kept, "host", n_active.alias("n_active"), "rule", (n_active > 0).alias("blocked")
    )
