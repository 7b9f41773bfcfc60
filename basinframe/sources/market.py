"""Price, stock, production, rig, export and futures feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinframe.errors import ContractViolation, SourceUnavailable
from basinframe.functions import codes
from basinframe.functions.scalars import (
    code_lookup,
    contract_code,
    first_delivery,
    last_trade_date,
    month_start,
    parse_date,
    sheet_month,
)
from basinframe.operators.contracts import (
    Contract,
    Guard,
    Monotone,
    eq,
    ge,
    gt,
    guard,
    in_range,
    isin,
    length,
    matches,
    non_null,
    not_startswith,
    nullable,
    require_columns,
    require_none,
    strict_double,
    truncated,
)
from basinframe.sources.spec import Feed

# ---- spot prices ------------------------------------------------------------------

SPOT_JSON = (
    "series_id string, error_message string, observations array<struct<date string, value string>>"
)


def spot_rows(docs: DataFrame) -> DataFrame:
    return docs.select("series_id", F.explode("observations").alias("o")).select("series_id", "o.*")


def normalize_spot(raw: DataFrame, metrics: dict[str, str] = codes.SPOT_METRICS) -> DataFrame:
    """``.`` marks a missing value and is dropped; negative prices are real."""
    return raw.where(F.coalesce(F.col("value") != ".", F.lit(True))).select(
        F.to_date("date").alias("date"),
        "series_id",
        code_lookup("series_id", metrics).alias("metric"),
        F.col("value").try_cast("double").alias("value"),
    )


SPOT = Feed(
    "fred",
    Contract(
        "fred",
        {
            "date": non_null("date"),
            "series_id": non_null("string", isin(list(codes.SPOT_METRICS))),
            "metric": non_null("string", isin(list(codes.SPOT_METRICS.values()))),
            "value": non_null("double"),
        },
        unique=("date", "series_id"),
    ),
    normalize_spot,
    spot_rows,
    lambda: (Guard("payload has no observations", F.col("observations").isNull(), SourceUnavailable),),
)

# ---- weekly energy series and country production --------------------------------------

WEEKLY_JSON = (
    "series_id string, metric string, error struct<code string, message string>, "
    "response struct<total string, data array<struct<period string, value string>>>"
)


def weekly_rows(docs: DataFrame) -> DataFrame:
    return docs.select("series_id", "metric", F.explode("response.data").alias("o")).select(
        "series_id", "metric", "o.*"
    )


def normalize_weekly(raw: DataFrame) -> DataFrame:
    """Null and marker values are absent, never zero."""
    present = raw.where(F.col("value").isNotNull() & ~F.col("value").isin(*codes.WEEKLY_ABSENT))
    period = F.coalesce(parse_date("period", "yyyy-MM-dd"), month_start("period"))
    return present.select(
        period.alias("period"), "series_id", "metric", F.col("value").try_cast("double").alias("value")
    )


def _weekly_guards() -> tuple[Guard, ...]:
    return (
        Guard("error body", F.col("error").isNotNull(), SourceUnavailable),
        Guard("no response data", F.col("response.data").isNull(), SourceUnavailable),
        Guard("empty response data", F.size("response.data") == 0, SourceUnavailable),
        Guard(
            "truncated response",
            truncated(F.col("response.total"), F.size("response.data")),
            SourceUnavailable,
        ),
    )

WEEKLY = Feed(
    "eia_v2",
    Contract(
        "eia_v2",
        {
            "period": non_null("date"),
            "series_id": non_null("string", matches(r"^PET\.[A-Z0-9]+\.W$")),
            "metric": non_null("string", matches(r"^[a-z0-9_]+_(kbbl|kbd)$")),
            "value": non_null("double", ge(0)),
        },
        unique=("period", "series_id"),
    ),
    normalize_weekly,
    weekly_rows,
    _weekly_guards,
)


def normalize_country_production(raw: DataFrame, pins: DataFrame) -> DataFrame:
    """Monthly series with the country of their pin (``series_id, iso3``)."""
    tidy = normalize_weekly(raw.withColumn("metric", F.lit("crude_production_kbd")))
    named = tidy.join(pins.select("series_id", F.col("iso3").alias("country_iso3")), "series_id")
    return named.select("period", "series_id", "country_iso3", "metric", "value")


COUNTRY_PRODUCTION = Feed(
    "eia_v2",
    Contract(
        "eia_v2",
        {
            "period": non_null("date"),
            "series_id": non_null("string", matches(r"^INTL\.57-1-[A-Z]{3}-TBPD\.M$")),
            "country_iso3": non_null("string", matches("^[A-Z]{3}$")),
            "metric": non_null("string", eq("crude_production_kbd")),
            "value": non_null("double", ge(0)),
        },
        unique=("period", "series_id"),
    ),
    normalize_country_production,
    weekly_rows,
    _weekly_guards,
)

# ---- country flows --------------------------------------------------------------------


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Every field as literal text: ``N/A`` must survive the reader."""
    schema = ", ".join(f"{c} string" for c in codes.FLOW_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def _flow_value() -> tuple[Column, Column]:
    """Only the listed markers mean absence; a blank or missing value is junk."""
    value, junk = strict_double("OBS_VALUE", codes.FLOW_ABSENT)
    return value, junk | F.col("OBS_VALUE").isNull()


def normalize_flows(raw: DataFrame, product: str = "CRUDEOIL") -> DataFrame:
    require_columns(raw, codes.FLOW_COLUMNS, "jodi")
    value, _ = _flow_value()
    kept = raw.where((F.col("ENERGY_PRODUCT") == product) & ~F.coalesce(F.col("OBS_VALUE").isin(*codes.FLOW_ABSENT), F.lit(False)))
    return kept.select(
        month_start("TIME_PERIOD").alias("period"),
        F.col("REF_AREA").alias("ref_area"),
        F.col("ENERGY_PRODUCT").alias("energy_product"),
        F.col("FLOW_BREAKDOWN").alias("flow_breakdown"),
        F.col("UNIT_MEASURE").alias("unit_measure"),
        value.alias("value"),
        F.coalesce("ASSESSMENT_CODE", F.lit("")).alias("assessment_code"),
    )


FLOWS = Feed(
    "jodi",
    Contract(
        "jodi",
        {
            "period": non_null("date"),
            "ref_area": non_null("string", length(2, 2)),
            "energy_product": non_null("string", isin(["CRUDEOIL"])),
            "flow_breakdown": non_null("string", isin(codes.FLOWS)),
            "unit_measure": non_null("string", isin(codes.FLOW_UNITS)),
            "value": non_null("double"),
            "assessment_code": non_null("string"),
        },
        unique=("ref_area", "period", "energy_product", "flow_breakdown", "unit_measure"),
    ),
    normalize_flows,
    lambda df: df,
    row_guards=lambda: (
        Guard("unrecognised value marker", (F.col("ENERGY_PRODUCT") == "CRUDEOIL") & _flow_value()[1]),
    ),
)

# ---- rig counts -----------------------------------------------------------------------

RIG_COLUMNS = ["Country", "Basin", "DrillFor", "US_PublishDate", "Rig Count Value"]


def normalize_rigs(raw: DataFrame) -> DataFrame:
    """Incomplete rows are dropped, the rest summed by week, region, basin, fuel."""
    require_columns(raw, RIG_COLUMNS, "baker_hughes")
    full = raw.dropna(subset=RIG_COLUMNS)
    return (
        full.groupBy(
            F.to_date("US_PublishDate").alias("week"),
            code_lookup("Country", codes.RIG_REGIONS).alias("region"),
            F.trim("Basin").alias("basin"),
            code_lookup("DrillFor", codes.RIG_FUELS).alias("drill_for"),
        )
        .agg(F.sum(F.col("Rig Count Value").cast("bigint")).alias("rig_count"))
    )


def _complete() -> Column:
    out = F.lit(True)
    for c in RIG_COLUMNS:
        out = out & F.col(c).isNotNull()
    return out


RIGS = Feed(
    "baker_hughes",
    Contract(
        "baker_hughes",
        {
            "week": non_null("date"),
            "region": non_null("string", isin(list(codes.RIG_REGIONS.values()))),
            "basin": non_null("string"),
            "drill_for": non_null("string", isin(list(codes.RIG_FUELS.values()))),
            "rig_count": non_null("bigint", ge(0)),
        },
        unique=("week", "region", "basin", "drill_for"),
    ),
    normalize_rigs,
    row_guards=lambda: (
        Guard("unexpected country", _complete() & ~F.col("Country").isin(list(codes.RIG_REGIONS))),
        Guard("unexpected fuel", _complete() & ~F.col("DrillFor").isin(list(codes.RIG_FUELS))),
    ),
)

# ---- exports --------------------------------------------------------------------------

EXPORT_JSON = (
    "count int, data array<struct<refYear int, reporterISO string, reporterDesc string, "
    "primaryValue double, flowCode string, cmdCode string, partnerCode int, partner2Code int, "
    "motCode int, customsCode string, isReported boolean, isAggregate boolean>>"
)


def export_rows(docs: DataFrame) -> DataFrame:
    return docs.select("count", F.explode("data").alias("r")).select("count", "r.*")


def normalize_exports(raw: DataFrame, cap: int = codes.EXPORT_CAP) -> DataFrame:
    """The one row per reporter for the whole world; breakdown rows repeat it."""
    world = (
        (F.col("flowCode") == "X")
        & (F.col("cmdCode") == "2709")
        & (F.col("partnerCode") == 0)
        & (F.col("partner2Code") == 0)
        & (F.col("motCode") == 0)
        & (F.col("customsCode") == "C00")
    )
    kept = raw.where(world).dropna(subset=["primaryValue", "reporterISO", "reporterDesc", "refYear"])
    reported = F.coalesce("isReported", F.lit(False))
    return kept.select(
        F.col("refYear").alias("year"),
        F.col("reporterISO").alias("reporter_iso"),
        F.col("reporterDesc").alias("reporter"),
        F.col("primaryValue").alias("export_value_usd"),
        (~reported | F.coalesce("isAggregate", F.lit(False))).alias("is_estimate"),
        F.coalesce(F.col("count") == cap, F.lit(False)).alias("truncated"),
    )


EXPORTS = Feed(
    "comtrade",
    Contract(
        "comtrade",
        {
            "year": non_null("int", in_range(1962, 2100)),
            "reporter_iso": non_null("string", length(3, 3)),
            "reporter": non_null("string"),
            "export_value_usd": non_null("double", ge(0)),
            "is_estimate": non_null("boolean"),
            "truncated": non_null("boolean"),
        },
        unique=("year", "reporter_iso"),
    ),
    normalize_exports,
    export_rows,
)

# ---- member production ------------------------------------------------------------------

_MONTH_LABEL = r"^[A-Z][a-z]{2} \d{2}$"


def _member_cell(c: Column) -> tuple[Column, Column]:
    text = F.rtrim(F.trim(c), F.lit("*"))
    absent = text.isNull() | text.isin(*codes.MEMBER_ABSENT)
    value = F.when(~absent, F.replace(text, F.lit(","), F.lit("")).try_cast("double"))
    return value, ~absent & value.isNull()


def member_long(wide: DataFrame, country: str = "country") -> DataFrame:
    """Monthly columns of the wide table as rows ``country, label, cell``; averages
    by quarter or year and the change column are left behind."""
    import re

    months = [c for c in wide.columns if re.match(_MONTH_LABEL, c)]
    if len(months) < 2:
        raise ContractViolation("opec", "no monthly columns in the header")
    return wide.unpivot([country], [f"`{m}`" if " " in m else m for m in months], "label", "cell")


def normalize_members(wide: DataFrame) -> DataFrame:
    long = member_long(wide).where(~F.col("country").startswith("Total"))
    value, _ = _member_cell(F.col("cell"))
    yy = F.substring("label", 5, 2)
    century = F.when(yy >= "69", "19").otherwise("20")
    month = parse_date(F.concat(F.lit("01 "), F.substring("label", 1, 4), century, yy), "dd MMM yyyy")
    return long.withColumns({"production_kbd": value, "month": month}).where(
        "production_kbd IS NOT NULL"
    ).select("country", "month", "production_kbd", F.lit("semi_automated").alias("extraction"))


def member_total_gaps(wide: DataFrame, tolerance: float = codes.MEMBER_SUM_TOLERANCE) -> DataFrame:
    """Months whose member sum misses the reported total by more than rounding
    allows; months with any member or the total missing are not judged."""
    long = member_long(wide)
    value, _ = _member_cell(F.col("cell"))
    is_total = F.col("country").startswith("Total")
    g = long.withColumn("v", value).groupBy("label").agg(
        F.sum(F.when(~is_total, F.col("v"))).alias("member_sum"),
        F.count_if(~is_total & F.col("v").isNull()).alias("n_missing"),
        F.max(F.when(is_total, F.col("v"))).alias("reported_total"),
    )
    return g.where(
        (F.col("n_missing") == 0)
        & (F.abs(F.col("member_sum") - F.col("reported_total")) > tolerance)
    )


MEMBERS_CONTRACT = Contract(
    "opec",
    {
        "country": non_null("string", not_startswith("Total")),
        "month": non_null("date"),
        "production_kbd": non_null("double", ge(0)),
        "extraction": non_null("string", eq("semi_automated")),
    },
    unique=("country", "month"),
)


def load_members(wide: DataFrame) -> DataFrame:
    _, junk = _member_cell(F.col("cell"))
    guard(member_long(wide), "opec", [Guard("unreadable cell", junk)])
    rows = wide.where(~F.col("country").startswith("Total")).limit(codes.MEMBER_MIN_ROWS).count()
    if rows < codes.MEMBER_MIN_ROWS:
        raise ContractViolation("opec", f"only {rows} member rows")
    require_none(member_total_gaps(wide), "opec", "member sum differs from the reported total")
    return MEMBERS_CONTRACT.enforce(normalize_members(wide))


# ---- commodity sheet -------------------------------------------------------------------


def normalize_sheet(wide: DataFrame, units: dict[str, str], date: str = "date") -> DataFrame:
    """Named columns to rows. ``units`` holds the unit label printed under each name.
    Junk becomes NULL and fails the contract."""
    named = {c: codes.COMMODITIES[c.strip()] for c in wide.columns if c.strip() in codes.COMMODITIES}
    missing = sorted(set(codes.COMMODITIES.values()) - set(named.values()))
    if missing:
        raise SourceUnavailable("wb_pinksheet", f"columns missing {missing}")
    for c in named:
        if units.get(c, "").strip() not in codes.SHEET_UNITS:
            raise SourceUnavailable("wb_pinksheet", f"unit of {c} is {units.get(c)!r}")
    price = F.array(
        *[
            F.struct(
                F.lit(out).alias("commodity"),
                F.trim(F.col(f"`{c}`")).alias("cell"),
                F.lit(codes.SHEET_UNITS[units[c].strip()]).alias("units"),
            )
            for c, out in named.items()
        ]
    )
    long = wide.select(F.col(date).alias("label"), F.explode(price).alias("p")).select("label", "p.*")
    present = F.col("cell").isNotNull() & ~F.col("cell").isin(*codes.SHEET_ABSENT)
    return long.where(present).select(
        sheet_month("label").alias("month"),
        "commodity",
        F.col("cell").try_cast("double").alias("price"),
        "units",
    )


SHEET_CONTRACT = Contract(
    "wb_pinksheet",
    {
        "month": non_null("date"),
        "commodity": non_null("string", isin(list(codes.COMMODITIES.values()))),
        "price": non_null("double", gt(0)),
        "units": non_null("string", isin(list(codes.SHEET_UNITS.values()))),
    },
    unique=("month", "commodity"),
)

# ---- futures ----------------------------------------------------------------------------

#: Quotes land as rows ``asof_date, ticker, last_price, previous_close, currency``.
QUOTE_COLUMNS = ["asof_date", "ticker", "last_price", "previous_close", "currency"]


def quote_guards() -> list[Guard]:
    price = F.col("last_price").try_cast("double")
    return [
        Guard("quote not in USD", F.col("currency").isNotNull() & (F.col("currency") != "USD")),
        Guard("price is not a number", F.col("last_price").isNotNull() & price.isNull()),
    ]


def front_months(quotes: DataFrame) -> DataFrame:
    """One row per date and ticker, the price in the column of its unit."""
    commodity = code_lookup("ticker", {t: c for t, (c, _) in codes.FRONT_TICKERS.items()})
    unit = code_lookup("ticker", {t: u for t, (_, u) in codes.FRONT_TICKERS.items()})
    settle, prev = (F.col(c).try_cast("double") for c in ("last_price", "previous_close"))
    return quotes.where(F.col("ticker").isin(list(codes.FRONT_TICKERS))).select(
        F.to_date("asof_date").alias("asof_date"),
        "ticker",
        commodity.alias("commodity"),
        F.when(unit == "usd_bbl", settle).alias("settle_usd_bbl"),
        F.when(unit == "usd_gal", settle).alias("settle_usd_gal"),
        F.when(unit == "usd_bbl", prev).alias("prev_close_usd_bbl"),
        F.when(unit == "usd_gal", prev).alias("prev_close_usd_gal"),
        F.lit(True).alias("indicative"),
    )


def missing_tickers(quotes: DataFrame, tickers: Sequence[str] = tuple(codes.FRONT_TICKERS)) -> DataFrame:
    """Dates on which a ticker has no quote."""
    have = quotes.groupBy("asof_date").agg(
        F.collect_set(F.when(F.col("ticker").isin(list(tickers)), F.col("ticker"))).alias("t")
    )
    want = F.array(*[F.lit(t) for t in tickers])
    return have.select("asof_date", F.explode(F.array_except(want, "t")).alias("ticker"))


FRONT_CONTRACT = Contract(
    "yf_curve",
    {
        "asof_date": non_null("date"),
        "ticker": non_null("string", isin(list(codes.FRONT_TICKERS))),
        "commodity": non_null("string", isin([c for c, _ in codes.FRONT_TICKERS.values()])),
        "settle_usd_bbl": nullable("double", gt(0)),
        "settle_usd_gal": nullable("double", gt(0)),
        "prev_close_usd_bbl": nullable("double", gt(0)),
        "prev_close_usd_gal": nullable("double", gt(0)),
        "indicative": non_null("boolean", eq(True)),
    },
    unique=("asof_date", "ticker"),
    row_checks={
        "settle_in_one_unit": lambda: F.col("settle_usd_bbl").isNotNull()
        != F.col("settle_usd_gal").isNotNull()
    },
)


def load_front_months(quotes: DataFrame) -> DataFrame:
    guard(quotes, "yf_curve", quote_guards(), empty="no quotes")
    require_none(missing_tickers(quotes), "yf_curve", "front-month quote missing")
    return FRONT_CONTRACT.enforce(front_months(quotes))


def strip_calendar(asof: DataFrame, months: int = 12) -> DataFrame:
    """Dated contracts M1..M``months`` for every ``asof_date``."""
    start = first_delivery("asof_date")
    fan = asof.select("asof_date").distinct().withColumns(
        {"__d0": start, "month_index": F.explode(F.sequence(F.lit(1), F.lit(months)))}
    )
    delivery = F.add_months("__d0", F.col("month_index") - 1)
    return fan.select(
        "asof_date",
        "month_index",
        contract_code(delivery).alias("contract"),
        delivery.alias("delivery_month"),
        last_trade_date(delivery).alias("expiry"),
    )


def curve_strip(quotes: DataFrame, months: int = 12) -> DataFrame:
    """Contract calendar left-joined to the quotes; a hole keeps a NULL price and
    then fails the contract."""
    dated = quotes.withColumn("asof_date", F.to_date("asof_date"))
    priced = dated.select(
        "asof_date",
        F.col("ticker").alias("contract"),
        F.col("last_price").try_cast("double").alias("settle_usd_bbl"),
    )
    cal = strip_calendar(dated, months)
    return cal.join(priced, ["asof_date", "contract"], "left").select(
        "asof_date", "month_index", "contract", "expiry", "settle_usd_bbl", F.lit(True).alias("indicative")
    )


def strip_holes(quotes: DataFrame, months: int = 12) -> DataFrame:
    have = quotes.select(F.to_date("asof_date").alias("asof_date"), F.col("ticker").alias("contract"))
    return strip_calendar(have, months).join(have, ["asof_date", "contract"], "left_anti").select(
        "asof_date", "month_index", "contract"
    )


STRIP_CONTRACT = Contract(
    "yf_curve",
    {
        "asof_date": non_null("date"),
        "month_index": non_null("int", in_range(1, 12)),
        "contract": non_null("string", matches(r"^CL[FGHJKMNQUVXZ]\d{2}\.NYM$")),
        "expiry": non_null("date"),
        "settle_usd_bbl": non_null("double", gt(0)),
        "indicative": non_null("boolean", eq(True)),
    },
    unique=("asof_date", "contract"),
    monotone=(Monotone("expiry_monotonic", ("asof_date",), "month_index", "expiry"),),
)


def load_strip(quotes: DataFrame, months: int = 12) -> DataFrame:
    guard(quotes, "yf_curve", quote_guards(), empty="no quotes")
    require_none(strip_holes(quotes, months), "yf_curve", "strip quote missing")
    return STRIP_CONTRACT.enforce(curve_strip(quotes, months))
