"""Newest dated download link of landed HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.functions.scalars import parse_date

_ANCHOR = r"(?is)<a\s[^>]*>"
#: What the rig page types and titles its current workbook.
WORKBOOK_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"
SHEET_FILE = "CMO-Historical-Data-Monthly.xlsx"


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, or NULL."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    double, single = F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2)
    return F.when(tag.rlike(pattern), F.when(double != "", double).otherwise(single))


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Every link of every page in order, exploded next to the scan."""
    tags = F.regexp_extract_all(html, F.lit(_ANCHOR), F.lit(0))
    return (
        pages.select(key, F.posexplode(tags).alias("pos", "tag"))
        .withColumn("href", attribute(F.col("tag"), "href"))
        .where("href IS NOT NULL")
    )


def resolve(href: Column, base: str) -> Column:
    """Absolute link for the three forms pages use."""
    origin = "/".join(base.split("/")[:3])
    folder = base.rsplit("/", 1)[0]
    return (
        F.when(href.rlike("(?i)^https?://"), href)
        .when(href.startswith("/"), F.concat(F.lit(origin), href))
        .otherwise(F.concat(F.lit(folder + "/"), href))
    )


def latest_workbook(pages: DataFrame, base: str, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, stamp, url`` of the newest dated, typed workbook link per page."""
    a = anchors(pages, key, html)
    title = F.replace(F.coalesce(attribute(F.col("tag"), "title"), F.lit("")), F.lit("_"), F.lit(" "))
    dated = a.withColumns(
        {
            "type": attribute(F.col("tag"), "type"),
            "title": title,
            "stamp": parse_date(F.regexp_extract(title, r"^(\d{2}-\d{2}-\d{4})", 1), "MM-dd-yyyy"),
        }
    ).where(
        F.contains("href", F.lit("/static-files/"))
        & (F.col("type") == WORKBOOK_TYPE)
        & F.col("stamp").isNotNull()
        & F.contains(F.lower("title"), F.lit("rig count"))
    )
    best = dated.groupBy(key).agg(F.max(F.struct("stamp", "href")).alias("b"))
    return best.select(key, F.col("b.stamp").alias("stamp"), resolve(F.col("b.href"), base).alias("url"))


def first_link_to(pages: DataFrame, base: str, name: str = SHEET_FILE, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key, url`` of the first link on the page that names the file."""
    hit = anchors(pages, key, html).where(F.contains("href", F.lit(name)))
    return hit.groupBy(key).agg(F.min_by("href", "pos").alias("h")).select(key, resolve(F.col("h"), base).alias("url"))
