"""News events: optional fields, two time formats, one row per link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.functions.codes import EVENT_THEMES
from basinframe.functions.scalars import blank_to_null, parse_seen_at
from basinframe.operators.contracts import Contract, non_null, nullable, startswith
from basinframe.operators.ordered import first_row
from basinframe.sources.spec import Feed, at_of

EVENTS_JSON = (
    "articles array<struct<url string, title string, seendate string, domain string, "
    "sourcecountry string>>"
)
COLUMNS = ["seen_at", "title", "url", "domain", "source_country", "theme_tags"]


def event_rows(docs: DataFrame, file: str = "file") -> DataFrame:
    """One row per article with its place: file, then position in the file."""
    found = docs.select(file, *at_of(docs), F.posexplode("articles").alias("pos", "a"))
    pos = F.col("at") if "at" in docs.columns else F.col("pos")
    return found.select(F.col(file).alias("file"), pos.alias("pos"), "a.*")


def clean_events(raw: DataFrame) -> DataFrame:
    """Trimmed fields, blank to NULL, rows without a link dropped."""
    return raw.select(
        "file",
        "pos",
        parse_seen_at("seendate").alias("seen_at"),
        blank_to_null("title").alias("title"),
        blank_to_null("url").alias("url"),
        blank_to_null("domain").alias("domain"),
        blank_to_null("sourcecountry").alias("source_country"),
        F.lit(",".join(EVENT_THEMES)).alias("theme_tags"),
    ).where("url IS NOT NULL")


def normalize_events(raw: DataFrame) -> DataFrame:
    """The first row of each link stands, by file and position."""
    return first_row(clean_events(raw), ["url"], ["file", "pos"]).select(*COLUMNS)


EVENTS = Feed(
    "gdelt",
    Contract(
        "gdelt",
        {
            "seen_at": nullable("timestamp"),
            "title": nullable("string"),
            "url": non_null("string", startswith("http")),
            "domain": nullable("string"),
            "source_country": nullable("string"),
            "theme_tags": nullable("string"),
        },
        unique=("url",),
    ),
    normalize_events,
    event_rows,
)
