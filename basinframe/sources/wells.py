"""Five regulators' well tables, each to one shape before harmonisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basinframe.errors import ContractViolation, SourceUnavailable
from basinframe.functions import codes
from basinframe.functions.scalars import (
    code_lookup,
    epoch_ms_year,
    feet_to_metres,
    join_sorted_distinct,
    parse_date,
)
from basinframe.operators.contracts import (
    Contract,
    Field,
    Guard,
    collapse_identical,
    duplicate_keys,
    ge,
    guard,
    in_range,
    isin,
    non_null,
    nullable,
    require_columns,
    require_none,
    require_rows,
    startswith,
    strict_double,
)
from basinframe.sources.spec import Feed

COLUMNS = [
    "well_id",
    "lat",
    "lon",
    "spud_year",
    "purpose_raw",
    "purpose",
    "content_raw",
    "td_m",
    "discovery_id",
]


def _contract(source_id: str, prefix: str, first_year: int = 1900, **override: Field) -> Contract:
    fields = {
        "well_id": non_null("string", startswith(prefix)),
        "lat": nullable("double", in_range(-90, 90)),
        "lon": nullable("double", in_range(-180, 180)),
        "spud_year": nullable("int", in_range(first_year, 2100)),
        "purpose_raw": non_null("string"),
        "purpose": non_null("string", isin(codes.PURPOSES)),
        "content_raw": non_null("string"),
        "td_m": nullable("double", ge(0)),
        "discovery_id": nullable("string"),
    }
    return Contract(source_id, {**fields, **override}, unique=("well_id",))


def _number(name: str) -> tuple[Column, Column]:
    return strict_double(name, [""])


def _unknown(c: Column, known) -> Column:
    return ~F.coalesce(c, F.lit("")).isin(list(known))


def _tidy(df: DataFrame) -> DataFrame:
    return collapse_identical(df.select(*COLUMNS))


# ---- Norway -------------------------------------------------------------------------------


def read_norway(spark: SparkSession, path: str) -> DataFrame:
    """Header row decides the columns; the reader drops a byte-order mark."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    require_columns(raw, codes.NORWAY_COLUMNS, "sodir", SourceUnavailable)
    return raw


def norway_rows(raw: DataFrame) -> DataFrame:
    """Every field trimmed; an empty field is an empty string."""
    return raw.select(*[F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in raw.columns])


def normalize_norway(rows: DataFrame) -> DataFrame:
    npdid, found = F.col("dscNpdidDiscovery"), F.col("wlbDiscovery")
    return _tidy(
        rows.select(
            F.concat(F.lit("sodir:"), F.col("wlbWellboreName")).alias("well_id"),
            _number("wlbNsDecDeg")[0].alias("lat"),
            _number("wlbEwDecDeg")[0].alias("lon"),
            F.year(parse_date("wlbEntryDate", "dd.MM.yyyy")).alias("spud_year"),
            F.col("wlbPurpose").alias("purpose_raw"),
            code_lookup("wlbPurpose", codes.NORWAY_PURPOSES).alias("purpose"),
            F.col("wlbContent").alias("content_raw"),
            _number("wlbTotalDepth")[0].alias("td_m"),
            F.when((npdid != "") | (found != ""), F.concat(F.lit("sodir:"), npdid, F.lit(":"), found)).alias(
                "discovery_id"
            ),
        )
    )


NORWAY = Feed(
    "sodir",
    _contract("sodir", "sodir:"),
    normalize_norway,
    norway_rows,
    row_guards=lambda: (
        Guard("blank wellbore name", F.col("wlbWellboreName") == ""),
        Guard("unmapped purpose", _unknown(F.col("wlbPurpose"), codes.NORWAY_PURPOSES)),
        Guard(
            "entry date is not DD.MM.YYYY",
            (F.col("wlbEntryDate") != "") & parse_date("wlbEntryDate", "dd.MM.yyyy").isNull(),
        ),
        Guard(
            "unreadable number",
            _number("wlbNsDecDeg")[1] | _number("wlbEwDecDeg")[1] | _number("wlbTotalDepth")[1],
        ),
    ),
)

# ---- United Kingdom ---------------------------------------------------------------------------

UK_JSON = (
    "error struct<code: string, message: string>, features array<struct<attributes: "
    "map<string, string>, geometry: struct<x: string, y: string>>>"
)
_UK_FIELDS = [
    "WELLREGNO", "ORIGINTENT", "FLOWCLASS", "SPUDDATE", "TDTVDSSM", "TARGETFLD", "TOPHOLEXDD", "TOPHOLEYDD",
]


def uk_rows(pages: DataFrame) -> DataFrame:
    """Attributes arrive as a map, so a missing key differs from a null value."""
    f = pages.select(F.explode("features").alias("f"))
    a = F.col("f.attributes")
    missing = F.array_except(F.array(*[F.lit(k) for k in _UK_FIELDS]), F.map_keys(a))
    return f.select(
        *[F.try_element_at(a, F.lit(k)).alias(k) for k in _UK_FIELDS],
        F.col("f.geometry.x").alias("gx"),
        F.col("f.geometry.y").alias("gy"),
        F.size(missing).alias("n_missing"),
    )


def _uk_coord(geometry: str, fallback: str) -> tuple[Column, Column]:
    both = F.col("gx").isNotNull() & F.col("gy").isNotNull()
    g, gj = _number(geometry)
    t, tj = _number(fallback)
    return F.when(both, g).otherwise(t), F.when(both, gj).otherwise(tj)


def normalize_uk(rows: DataFrame) -> DataFrame:
    """Geometry first, text coordinates second; a storage registration is never an
    exploration well; depths below the sea come in two signs."""
    storage = F.col("WELLREGNO").rlike(r"^C\d")
    target = F.col("TARGETFLD")
    return _tidy(
        rows.select(
            F.concat(F.lit("nsta:"), F.col("WELLREGNO")).alias("well_id"),
            _uk_coord("gy", "TOPHOLEYDD")[0].alias("lat"),
            _uk_coord("gx", "TOPHOLEXDD")[0].alias("lon"),
            epoch_ms_year("SPUDDATE").alias("spud_year"),
            F.col("ORIGINTENT").alias("purpose_raw"),
            F.when(storage, "other").otherwise(code_lookup("ORIGINTENT", codes.UK_PURPOSES)).alias("purpose"),
            F.coalesce("FLOWCLASS", F.lit("")).alias("content_raw"),
            F.abs(_number("TDTVDSSM")[0]).alias("td_m"),
            F.when(target != codes.UK_NO_DATA, target).alias("discovery_id"),
        )
    )


UK = Feed(
    "nsta",
    _contract("nsta", "nsta:", purpose_raw=non_null("string", isin(list(codes.UK_PURPOSES)))),
    normalize_uk,
    uk_rows,
    lambda: (
        Guard("error body", F.col("error").isNotNull(), SourceUnavailable),
        Guard("no feature list", F.col("features").isNull(), SourceUnavailable),
    ),
    lambda: (
        Guard("feature without registration number", F.coalesce("WELLREGNO", F.lit("")) == ""),
        Guard("attribute missing", F.col("n_missing") > 0),
        Guard("intent outside the request", _unknown(F.col("ORIGINTENT"), codes.UK_PURPOSES)),
        Guard("spud date is not epoch milliseconds", F.col("SPUDDATE").isNotNull() & epoch_ms_year("SPUDDATE").isNull()),
        Guard(
            "unreadable number",
            _uk_coord("gy", "TOPHOLEYDD")[1] | _uk_coord("gx", "TOPHOLEXDD")[1] | _number("TDTVDSSM")[1],
        ),
    ),
)

# ---- Netherlands ----------------------------------------------------------------------------------

NETHERLANDS_JSON = (
    "numberMatched int, numberReturned int, features array<struct<properties: struct<"
    "BOREHOLE_CODE: string, START_DATE_DRILLING: string, BOREHOLE_TYPE_CODE: string, "
    "BOREHOLE_RESULT_CODE: string, END_DEPTH_MAH: double, FIELD_CODE: string>, "
    "geometry: struct<coordinates: array<double>>>>"
)


def netherlands_rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry.coordinates")


def normalize_netherlands(rows: DataFrame) -> DataFrame:
    head = F.substring("START_DATE_DRILLING", 1, 4)
    field = F.col("FIELD_CODE")
    return _tidy(
        rows.select(
            F.concat(F.lit("nlog:"), F.col("BOREHOLE_CODE")).alias("well_id"),
            F.try_element_at("coordinates", F.lit(2)).alias("lat"),
            F.try_element_at("coordinates", F.lit(1)).alias("lon"),
            F.when(head.rlike(r"^\d+$"), head.try_cast("int")).alias("spud_year"),
            F.coalesce("BOREHOLE_TYPE_CODE", F.lit("")).alias("purpose_raw"),
            code_lookup("BOREHOLE_TYPE_CODE", codes.NETHERLANDS_PURPOSES).alias("purpose"),
            F.coalesce("BOREHOLE_RESULT_CODE", F.lit("")).alias("content_raw"),
            F.col("END_DEPTH_MAH").cast("double").alias("td_m"),
            F.when(field != "", field).alias("discovery_id"),
        )
    )


NETHERLANDS = Feed(
    "nlog",
    _contract("nlog", "nlog:", 1500),
    normalize_netherlands,
    netherlands_rows,
    lambda: (
        Guard("no feature list", F.col("features").isNull(), SourceUnavailable),
        Guard("truncated page", F.col("numberReturned") < F.col("numberMatched"), SourceUnavailable),
        Guard("zero features", F.size("features") == 0, SourceUnavailable),
    ),
    lambda: (
        Guard("feature without borehole code", F.coalesce("BOREHOLE_CODE", F.lit("")) == ""),
        Guard("unmapped type code", _unknown(F.col("BOREHOLE_TYPE_CODE"), codes.NETHERLANDS_PURPOSES)),
    ),
)

# ---- Gulf of Mexico -----------------------------------------------------------------------------------


def read_us_gulf(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    require_columns(raw, codes.US_GULF_COLUMNS, "boem_bsee")
    return raw


def read_us_leases(spark: SparkSession, path: str) -> DataFrame:
    """Headerless list of exactly ten columns."""
    width = len(spark.read.csv(path).columns)
    if width != len(codes.US_GULF_LEASE_COLUMNS):
        raise ContractViolation("boem_bsee", f"lease list has {width} columns")
    return spark.read.schema(", ".join(f"{c} string" for c in codes.US_GULF_LEASE_COLUMNS)).csv(path)


def us_gulf_rows(raw: DataFrame) -> DataFrame:
    cols = [F.coalesce(F.trim(c), F.lit("")).alias(c) for c in codes.US_GULF_COLUMNS]
    return raw.select(*cols).where("REGION_CODE = 'G'")


def fields_of_leases(leases: DataFrame) -> DataFrame:
    """``lease, discovery_id``: a lease in several fields carries all of them."""
    pairs = leases.select(F.trim("lease_number").alias("lease"), F.trim("field_name_code").alias("f")).distinct()
    return pairs.groupBy("lease").agg(join_sorted_distinct("f").alias("discovery_id"))


def normalize_us_gulf(rows: DataFrame, leases: DataFrame) -> DataFrame:
    """A lease that lies in a named field stands in for a discovery."""
    depth = strict_double("BH_TOTAL_MD", ["", codes.US_GULF_WITHHELD])[0]
    proxied = rows.withColumn("lease", F.col("BOTM_LEASE_NUMBER")).join(fields_of_leases(leases), "lease", "left")
    return _tidy(
        proxied.select(
            F.concat(F.lit("boem:"), F.col("API_WELL_NUMBER")).alias("well_id"),
            _number("SURF_LATITUDE")[0].alias("lat"),
            _number("SURF_LONGITUDE")[0].alias("lon"),
            F.year(parse_date("WELL_SPUD_DATE", "M/d/yyyy")).alias("spud_year"),
            F.col("WELL_TYPE_CODE").alias("purpose_raw"),
            code_lookup("WELL_TYPE_CODE", codes.US_GULF_PURPOSES).alias("purpose"),
            F.when(F.col("discovery_id").isNotNull(), codes.US_GULF_MATCH)
            .otherwise(codes.US_GULF_NO_MATCH)
            .alias("content_raw"),
            feet_to_metres(depth).alias("td_m"),
            "discovery_id",
        )
    )


US_GULF = Feed(
    "boem_bsee",
    _contract(
        "boem_bsee",
        "boem:",
        lat=nullable("double", in_range(23.0, 32.0)),
        lon=nullable("double", in_range(-98.0, -80.0)),
        purpose_raw=non_null("string", isin(list(codes.US_GULF_PURPOSES))),
        content_raw=non_null("string", isin([codes.US_GULF_MATCH, codes.US_GULF_NO_MATCH])),
    ),
    normalize_us_gulf,
    us_gulf_rows,
    row_guards=lambda: (
        Guard("missing well number", F.col("API_WELL_NUMBER") == ""),
        Guard(
            "spud date is not M/D/YYYY",
            (F.col("WELL_SPUD_DATE") != "") & parse_date("WELL_SPUD_DATE", "M/d/yyyy").isNull(),
        ),
        Guard("type code outside the legend", _unknown(F.col("WELL_TYPE_CODE"), codes.US_GULF_PURPOSES)),
        Guard(
            "unreadable number",
            _number("SURF_LATITUDE")[1]
            | _number("SURF_LONGITUDE")[1]
            | strict_double("BH_TOTAL_MD", ["", codes.US_GULF_WITHHELD])[1],
        ),
    ),
)


def load_us_gulf(raw: DataFrame, leases: DataFrame) -> DataFrame:
    require_rows(leases, "boem_bsee", ContractViolation)
    return US_GULF.load(raw, leases=leases)


# ---- Australia ------------------------------------------------------------------------------------------

AUSTRALIA_WELLS_JSON = (
    "error string, value array<struct<Borehole_ID: string, Kick_Off_Date: string, "
    "Borehole_Reason: string, Drillers_TD_m: double>>"
)
AUSTRALIA_POINTS_JSON = (
    "error string, features array<struct<attributes: struct<Ubhi: string, Latitude: double, Longitude: double>>>"
)


def australia_wells(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.explode("value").alias("r")).select("r.*")
    return collapse_identical(rows, ["Borehole_ID", "Kick_Off_Date", "Borehole_Reason", "Drillers_TD_m"])


def australia_points(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.explode("features").alias("f")).select("f.attributes.*")
    return collapse_identical(rows, ["Ubhi", "Latitude", "Longitude"])


def normalize_australia(wells: DataFrame, points: DataFrame) -> DataFrame:
    """Attributes joined to points; wells without a point are left out. No outcome
    is published, so every row carries the empty code."""
    reason = F.coalesce("Borehole_Reason", F.lit(""))
    joined = wells.join(points.withColumnRenamed("Ubhi", "Borehole_ID"), "Borehole_ID", "inner")
    return joined.select(
        F.concat(F.lit("nopims:"), F.col("Borehole_ID")).alias("well_id"),
        F.col("Latitude").cast("double").alias("lat"),
        F.col("Longitude").cast("double").alias("lon"),
        F.year(parse_date("Kick_Off_Date", "yyyy-MM-dd")).alias("spud_year"),
        reason.alias("purpose_raw"),
        code_lookup(reason, codes.AUSTRALIA_PURPOSES).alias("purpose"),
        F.lit("").alias("content_raw"),
        F.col("Drillers_TD_m").cast("double").alias("td_m"),
        F.lit(None).cast("string").alias("discovery_id"),
    )


AUSTRALIA_CONTRACT = _contract("nopims", "nopims:", content_raw=non_null("string", isin([""])))


def load_australia(well_pages: DataFrame, point_pages: DataFrame) -> DataFrame:
    for pages, part in ((well_pages, "value"), (point_pages, "features")):
        guard(
            pages,
            "nopims",
            [Guard(f"page has no {part}", F.col(part).isNull() | F.col("error").isNotNull(), SourceUnavailable)],
            empty="nothing landed",
        )
    wells, points = australia_wells(well_pages), australia_points(point_pages)
    kicked = F.col("Kick_Off_Date")
    guard(
        wells,
        "nopims",
        [
            Guard("blank borehole id", F.coalesce("Borehole_ID", F.lit("")) == ""),
            Guard("unmapped reason", _unknown(F.col("Borehole_Reason"), codes.AUSTRALIA_PURPOSES)),
            Guard("kick-off date is not YYYY-MM-DD", kicked.isNotNull() & parse_date("Kick_Off_Date", "yyyy-MM-dd").isNull()),
        ],
        empty="no wells",
    )
    require_none(duplicate_keys(require_rows(points, "nopims"), ["Ubhi"]), "nopims", "conflicting points")
    return AUSTRALIA_CONTRACT.enforce(require_rows(normalize_australia(wells, points), "nopims"))
