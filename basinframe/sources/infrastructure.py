"""Pipelines, terminals, fields and protected areas from GeoJSON and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.errors import SourceUnavailable
from basinframe.functions import codes
from basinframe.functions.scalars import int_year, start_year
from basinframe.operators.contracts import (
    Contract,
    Guard,
    collapse_identical,
    ge,
    guard,
    in_range,
    isin,
    length,
    non_null,
    nullable,
    require_columns,
    require_none,
    require_rows,
    startswith,
)
from basinframe.operators.ordered import prefix
from basinframe.operators.polygons import decimate_line
from basinframe.session import small_table
from basinframe.sources.spec import Feed, at_of

_PROPS = (
    "struct<`project-id`: string, name: string, status: string, `country-area1`: string, "
    "`start-year`: string, `discovery-year`: string, `facility-type`: string, fuel: string, "
    "Latitude: string, Longitude: string>"
)
#: Coordinates nest by geometry type, so they arrive as JSON text.
FEATURE = f"struct<properties: {_PROPS}, geometry: struct<type: string, coordinates: string>>"
FEATURES_JSON = f"features array<{FEATURE}>"


def feature_rows(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per feature, with its place: the document's ``at`` where it has one."""
    found = docs.select(*carry, *at_of(docs), F.posexplode("features").alias("pos", "f"))
    return found.withColumn("pos", F.col("at") if "at" in docs.columns else F.col("pos")).select(
        *carry, "pos", "f.properties.*", F.col("f.geometry.type").alias("geometry_type"), "f.geometry.coordinates"
    )


def _text(name: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{name}`")), F.lit(""))


# ---- pipelines and terminals --------------------------------------------------------------


def infra_kind() -> Column:
    """Kind of a feature of ``tracker``; NULL when it cannot be told."""
    facility = F.lower(_text("facility-type"))
    return (
        F.when(F.col("tracker") == "goit", "oil_pipeline")
        .when(facility == "import", "lng_import")
        .when(facility == "export", "lng_export")
        .when(_text("fuel") == "Gas", "gas_pipeline")
    )


def _kept() -> Column:
    return _text("status").isin(*codes.INFRA_STATUSES)


def _untyped_terminal() -> Column:
    return (F.col("geometry_type") == "Point") & (_text("facility-type") == "")


def _terminal() -> Column:
    return infra_kind().isin("lng_import", "lng_export")


def infra_guards() -> list[Guard]:
    return [
        Guard("feature without project id", _text("project-id") == ""),
        Guard(
            "unclassifiable feature",
            _kept() & infra_kind().isNull() & ~F.coalesce(_untyped_terminal(), F.lit(False)),
        ),
        Guard("too many untyped terminals", _kept() & infra_kind().isNull(), allowed=codes.INFRA_SKIP_ALLOWED),
        Guard("unreadable start year", _kept() & infra_kind().isNotNull() & start_year("`start-year`")[1]),
        Guard(
            "terminal without position",
            _kept()
            & _terminal()
            & (F.col("Latitude").try_cast("double").isNull() | F.col("Longitude").try_cast("double").isNull()),
        ),
        Guard(
            "pipeline without a line",
            _kept()
            & F.coalesce(infra_kind().isin("oil_pipeline", "gas_pipeline"), F.lit(False))
            & ~F.coalesce(F.col("geometry_type").isin("LineString", "MultiLineString"), F.lit(False)),
        ),
    ]


def line_vertices() -> Column:
    """All vertices of a line or multi-line in order."""
    one = F.from_json("coordinates", "array<array<double>>")
    many = F.flatten(F.from_json("coordinates", "array<array<array<double>>>"))
    return F.when(F.col("geometry_type") == "LineString", one).when(
        F.col("geometry_type") == "MultiLineString", many
    )


def normalize_infra(raw: DataFrame, stride: int = codes.INFRA_VERTEX_STRIDE) -> DataFrame:
    """Kept features as points: one per terminal, every ``stride``-th vertex and the
    last per pipeline, numbered within (kind, project) across its features."""
    kept = raw.where(_kept() & infra_kind().isNotNull()).withColumns(
        {
            "kind": infra_kind(),
            "project_id": _text("project-id"),
            "start_year": start_year("`start-year`")[0],
            "country": F.coalesce(F.col("`country-area1`"), F.lit("")),
            "name": F.coalesce("name", F.lit("")),
            "status": _text("status"),
        }
    )
    here = F.array(F.array(F.col("Longitude").try_cast("double"), F.col("Latitude").try_cast("double")))
    points = F.when(F.col("kind").isin("lng_import", "lng_export"), here).otherwise(F.col("line"))
    flat = (
        kept.withColumn("vertices", line_vertices())
        .withColumn("line", decimate_line("vertices", stride))
        .select(
            "kind", "project_id", "name", "status", "country", "start_year", "pos",
            F.posexplode(points).alias("vertex", "p"),
        )
        .select(
            "kind", "project_id", "name", "status", "country", "start_year", "pos", "vertex",
            F.element_at("p", 2).alias("lat"),
            F.element_at("p", 1).alias("lon"),
        )
    )
    numbered = prefix(flat, ["kind", "project_id"], ["pos", "vertex"], ordinal="__i")
    return numbered.select(
        "kind", "project_id", "name", "status", "country", "start_year",
        (F.col("__i") - 1).alias("vertex_idx"), "lat", "lon",
    )


INFRA_CONTRACT = Contract(
    "gem_infra",
    {
        "kind": non_null("string", isin(codes.INFRA_KINDS)),
        "project_id": non_null("string", length(1)),
        "name": non_null("string"),
        "status": non_null("string", isin(codes.INFRA_STATUSES)),
        "country": non_null("string"),
        "start_year": nullable("int", in_range(1800, 2100)),
        "vertex_idx": non_null("bigint", ge(0)),
        "lat": non_null("double", in_range(-90, 90)),
        "lon": non_null("double", in_range(-180, 180)),
    },
    unique=("kind", "project_id", "vertex_idx"),
)


def load_infra(docs: DataFrame) -> DataFrame:
    """``docs``: one row per file, ``tracker, features``."""
    guard(
        docs,
        "gem_infra",
        [
            Guard("unknown tracker", ~F.col("tracker").isin(*codes.INFRA_TRACKERS)),
            Guard("no feature list", F.col("features").isNull(), SourceUnavailable),
            Guard("zero features", F.size("features") == 0, SourceUnavailable),
        ],
        empty="nothing landed",
    )
    raw = feature_rows(docs, ("tracker",))
    guard(raw, "gem_infra", infra_guards())
    return INFRA_CONTRACT.enforce(require_rows(normalize_infra(raw), "gem_infra"))


def split_kinds(infra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pipeline vertices, terminals)."""
    return (
        infra.where(F.col("kind").isin("oil_pipeline", "gas_pipeline")),
        infra.where(F.col("kind").isin("lng_import", "lng_export")),
    )


def latest_releases(listing: DataFrame) -> DataFrame:
    """``tracker, key, size, release`` of the newest object per tracker from an
    object listing (``Key, Size``)."""
    pattern = codes.INFRA_KEY_PATTERN
    known = listing.where(F.col("Key").rlike(pattern) & F.col("Size").isNotNull()).select(
        F.regexp_extract("Key", pattern, 1).alias("tracker"),
        F.regexp_extract("Key", pattern, 2).alias("release"),
        F.col("Key").alias("key"),
        F.col("Size").cast("bigint").alias("size"),
    )
    best = known.groupBy("tracker").agg(F.max_by(F.struct("key", "size", "release"), F.col("release")).alias("b"))
    return best.select("tracker", "b.key", "b.size", "b.release")


def load_latest_releases(listing: DataFrame, head: DataFrame) -> DataFrame:
    """``head``: one row with ``IsTruncated``. Every tracker must be present."""
    guard(
        head,
        "gem_infra",
        [Guard("listing is truncated", F.lower(F.trim(F.col("IsTruncated").cast("string"))) == "true", SourceUnavailable)],
    )
    found = latest_releases(listing)
    want = small_table(listing.sparkSession, [(t,) for t in codes.INFRA_TRACKERS], "tracker string")
    require_none(want.join(found, "tracker", "left_anti"), "gem_infra", "no map object", SourceUnavailable)
    return found


# ---- fields -----------------------------------------------------------------------------------


def normalize_fields(raw: DataFrame) -> DataFrame:
    """Field points; identical rows collapse, conflicting ids fail the contract."""
    at = F.from_json("coordinates", "array<double>")
    out = raw.select(
        F.concat(F.lit("gem_goget:"), F.col("`project-id`")).alias("field_id"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce(F.col("`country-area1`"), F.lit("")).alias("country"),
        F.coalesce("status", F.lit("")).alias("status"),
        int_year("`discovery-year`")[0].alias("discovery_year"),
        F.try_element_at(at, F.lit(2)).alias("lat"),
        F.try_element_at(at, F.lit(1)).alias("lon"),
    )
    return collapse_identical(out)


FIELDS = Feed(
    "gem_goget",
    Contract(
        "gem_goget",
        {
            "field_id": non_null("string", startswith("gem_goget:")),
            "name": non_null("string"),
            "country": non_null("string"),
            "status": non_null("string", isin(codes.FIELD_STATUSES)),
            "discovery_year": nullable("int", in_range(1800, 2100)),
            "lat": non_null("double", in_range(-90, 90)),
            "lon": non_null("double", in_range(-180, 180)),
        },
        unique=("field_id",),
    ),
    normalize_fields,
    feature_rows,
    lambda: (Guard("no feature list", F.col("features").isNull(), SourceUnavailable),),
    lambda: (
        Guard("feature without project id", _text("project-id") == ""),
        Guard("geometry is not a point", ~F.coalesce(F.col("geometry_type") == "Point", F.lit(False))),
        Guard("malformed coordinates", F.coalesce(F.size(F.from_json("coordinates", "array<double>")), F.lit(0)) < 2),
        Guard("unreadable discovery year", int_year("`discovery-year`")[1]),
    ),
)

# ---- protected areas ------------------------------------------------------------------------------


def normalize_areas(raw: DataFrame) -> DataFrame:
    """Marine and coastal rows; year 0 means unknown."""
    require_columns(raw, codes.AREA_COLUMNS, "wdpa")
    kept = raw.where(F.col("REALM").isin(*codes.AREA_REALMS))
    year = F.col("STATUS_YR").try_cast("int")
    text = {c: F.col(c).cast("string") for c in codes.AREA_COLUMNS}
    return kept.select(
        text["SITE_ID"].alias("site_id"),
        text["NAME"].alias("name"),
        text["DESIG_ENG"].alias("desig_eng"),
        text["IUCN_CAT"].alias("iucn_cat"),
        text["STATUS"].alias("status"),
        F.nullif(year, F.lit(0)).alias("status_yr"),
        text["ISO3"].alias("iso3"),
        (F.col("REALM") == "Marine").alias("marine"),
    )


AREAS = Feed(
    "wdpa",
    Contract(
        "wdpa",
        {
            "site_id": non_null("string"),
            "name": non_null("string"),
            "desig_eng": non_null("string"),
            "iucn_cat": non_null("string"),
            "status": non_null("string", isin(codes.AREA_STATUSES)),
            "status_yr": nullable("int", in_range(1800, 2100)),
            "iso3": non_null("string"),
            "marine": non_null("boolean"),
        },
    ),
    normalize_areas,
)
