"""Readers of the feeds whose documents are one JSON value each."""

from __future__ import annotations

from pyspark.sql import functions as F

from basinframe.sources import events, governance, infrastructure, market, wells
from basinframe.sources.records import Reader

_OBSERVATION = "date string, value string"
_PERIOD = "period string, value string"
_ARTICLE = "url string, title string, seendate string, domain string, sourcecountry string"
_INDICATOR = (
    "indicator struct<id: string>, country struct<value: string>, countryiso3code string, date string, value double"
)


def _none(kind: str):
    return F.lit(None).cast(kind)


#: ``{"observations": [record, ...]}``; the request names the series.
SPOT = Reader(
    market.SPOT, 1, 1, _OBSERVATION, lambda one: {"observations": one, "error_message": _none("string")}
)
#: ``{"response": {"total": n, "data": [record, ...]}}``
WEEKLY = Reader(
    market.WEEKLY,
    2,
    1,
    _PERIOD,
    lambda one: {
        "response": F.struct(_none("string").alias("total"), one.alias("data")),
        "error": _none("struct<code:string,message:string>"),
    },
    r'"total"\s*:\s*"?(\d+)',
)
#: ``{"articles": [record, ...]}``
EVENTS = Reader(events.EVENTS, 1, 1, _ARTICLE, lambda one: {"articles": one})
#: ``[meta, [record, ...]]``
GOVERNANCE = Reader(
    governance.GOVERNANCE, 0, 2, _INDICATOR, lambda one: {"meta": _none("string"), "rows": one}, r'"total"\s*:\s*"?(\d+)'
)
#: ``{"type": ..., "features": [record, ...]}``
FIELDS = Reader(infrastructure.FIELDS, 1, 1, infrastructure.FEATURE, lambda one: {"features": one})
#: As above, with the number of features that the request matched in its head.
NETHERLANDS = Reader(
    wells.NETHERLANDS,
    1,
    1,
    "properties struct<BOREHOLE_CODE: string, START_DATE_DRILLING: string, BOREHOLE_TYPE_CODE: string, "
    "BOREHOLE_RESULT_CODE: string, END_DEPTH_MAH: double, FIELD_CODE: string>, geometry struct<coordinates: array<double>>",
    lambda one: {"features": one, "numberMatched": _none("int"), "numberReturned": _none("int")},
    r'"numberMatched"\s*:\s*(\d+)',
)
#: Pages ``{"features": [{"attributes": {...}, "geometry": {...}}, ...]}``
UK = Reader(
    wells.UK,
    1,
    1,
    "attributes map<string, string>, geometry struct<x: string, y: string>",
    lambda one: {"features": one, "error": _none("struct<code:string,message:string>")},
)
#: Monthly series of one country a document; ``load`` takes the pins.
COUNTRY_PRODUCTION = Reader(market.COUNTRY_PRODUCTION, 2, 1, _PERIOD, WEEKLY.wrap, WEEKLY.total)
