"""Governance indicators and sanctions lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinframe.errors import SourceUnavailable
from basinframe.functions import codes
from basinframe.functions.scalars import code_lookup, remove_prefix, split_tokens, strip_bom
from basinframe.operators.contracts import (
    Contract,
    Guard,
    ge,
    guard,
    in_range,
    isin,
    length,
    matches,
    missing_members,
    non_null,
    nullable,
    require_none,
)
from basinframe.session import materialize, small_table
from basinframe.sources.spec import Feed

# ---- governance ------------------------------------------------------------------------

_ROW = (
    "struct<indicator: struct<id: string>, country: struct<value: string>, "
    "countryiso3code: string, date: string, value: double>"
)


def governance_documents(text: DataFrame) -> DataFrame:
    """Documents are two-element arrays ``[meta, rows]`` of unlike types, so each
    element is taken as JSON text first. Input column ``value``."""
    parts = F.from_json(strip_bom("value"), "array<string>")
    return text.select(
        F.get(parts, F.lit(0)).alias("meta"),
        F.from_json(F.get(parts, F.lit(1)), f"array<{_ROW}>").alias("rows"),
    )


def governance_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode("rows").alias("r")).select("r.*")


def normalize_governance(raw: DataFrame) -> DataFrame:
    """A null score was not given; a row without a country code has no key."""
    iso3 = F.coalesce("countryiso3code", F.lit(""))
    return raw.where(F.col("value").isNotNull() & (iso3 != "")).select(
        iso3.alias("iso3"),
        F.col("country.value").alias("country"),
        remove_prefix("indicator.id", codes.GOVERNANCE_PREFIX).alias("indicator"),
        F.col("date").try_cast("int").alias("year"),
        F.col("value").cast("double").alias("value"),
    )


GOVERNANCE = Feed(
    "wgi",
    Contract(
        "wgi",
        {
            "iso3": non_null("string", length(3, 3)),
            "country": non_null("string"),
            "indicator": non_null("string", isin(list(codes.GOVERNANCE_INDICATORS))),
            "year": non_null("int", in_range(1996, 2100)),
            "value": non_null("double", in_range(-3.5, 3.5)),
        },
        unique=("iso3", "indicator", "year"),
    ),
    normalize_governance,
    governance_rows,
    lambda: (
        Guard("message body", F.get_json_object("meta", "$.message").isNotNull(), SourceUnavailable),
        Guard("no data rows", F.coalesce(F.size("rows"), F.lit(0)) <= 0, SourceUnavailable),
    ),
)


def load_governance(text: DataFrame) -> DataFrame:
    out = GOVERNANCE.load(governance_documents(text))
    want = small_table(out.sparkSession, [(c,) for c in codes.GOVERNANCE_INDICATORS], "member string")
    require_none(
        missing_members(out, "indicator", want, "member"), "wgi", "indicator has no rows", SourceUnavailable
    )
    return out


# ---- sanctions: delimited list -----------------------------------------------------------


def read_us_list(spark: SparkSession, path: str) -> DataFrame:
    """Headerless list of twelve columns; the closing 0x1A line is skipped, any
    other width is drift. Widths are judged on the parsed columns."""
    wide = [f"c{i} string" for i in range(codes.SANCTION_COLUMNS + 1)]
    raw = spark.read.schema(", ".join(wide)).option("escape", '"').csv(path)
    return raw


def us_rows(raw: DataFrame) -> DataFrame:
    rest_null = F.lit(True)
    for i in range(1, codes.SANCTION_COLUMNS + 1):
        rest_null = rest_null & F.col(f"c{i}").isNull()
    end = rest_null & (F.trim(F.replace("c0", F.lit("\x1a"), F.lit(""))) == "")
    return raw.where(~F.coalesce(end, F.lit(False)))


def us_entries(rows: DataFrame) -> DataFrame:
    names = ["ent_num", "name", "sdn_type", "programs"]
    return rows.select(*[F.trim(f"c{i}").alias(n) for i, n in enumerate(names)])


def _us_width() -> Guard:
    return Guard(
        f"row is not {codes.SANCTION_COLUMNS} columns wide",
        F.col(f"c{codes.SANCTION_COLUMNS - 1}").isNull() | F.col(f"c{codes.SANCTION_COLUMNS}").isNotNull(),
    )


def program_tokens(entries: DataFrame, cell: str = "programs") -> DataFrame:
    """``program, designation_count``: designations per token, counted map-side."""
    tokens = entries.select(F.explode(split_tokens(cell, codes.TOKEN_JOINER)).alias("program"))
    return tokens.groupBy("program").agg(F.count(F.lit(1)).alias("designation_count"))


def unknown_tokens(tokens: DataFrame, known: list[str]) -> DataFrame:
    return tokens.where(~F.col("program").isin(known))


def _country_rows(tokens: DataFrame, country_of: dict[str, str], source: str, generated) -> DataFrame:
    iso3 = code_lookup("program", country_of)
    return tokens.where(iso3.isNotNull()).select(
        iso3.alias("iso3"),
        code_lookup(iso3, codes.COUNTRY_NAMES).alias("country_name"),
        "program",
        F.lit(source).alias("list_source"),
        F.col("designation_count").cast("bigint").alias("designation_count"),
        generated.cast("timestamp").alias("list_generated_at"),
    )


def normalize_us(entries: DataFrame, strict: bool = True) -> DataFrame:
    tokens = program_tokens(entries)
    if strict:
        tokens = materialize(tokens, "tokens")  # one row per token; the list is read once
        known = [*codes.US_COUNTRY_TOKENS, *codes.US_THEMATIC_TOKENS]
        require_none(unknown_tokens(tokens, known), "ofac_eu", "unknown programme tokens")
    return _country_rows(tokens, codes.US_COUNTRY_TOKENS, "OFAC", F.lit(None))


def load_us(raw: DataFrame) -> DataFrame:
    rows = us_rows(raw)
    guard(rows, "ofac_eu", [_us_width()], empty="list has no entries")
    return normalize_us(us_entries(rows))


# ---- sanctions: XML list -------------------------------------------------------------------

EU_ENTITY_SCHEMA = "_logicalId string, regulation array<struct<_programme: string>>"


def read_eu_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, head): elements are read in parallel, the root attribute apart."""
    entities = spark.read.schema(EU_ENTITY_SCHEMA).xml(path, rowTag="sanctionEntity")
    head = spark.read.schema("_generationDate string").xml(path, rowTag="export")
    return entities, head.select(F.col("_generationDate").alias("generated"))


def normalize_eu(entities: DataFrame, generated: str, strict: bool = True) -> DataFrame:
    """Entities per programme; a programme counts once per entity."""
    own = F.array_distinct(F.transform("regulation", lambda r: F.trim(r["_programme"])))
    tokens = (
        entities.select(F.explode(own).alias("program"))
        .where(F.coalesce("program", F.lit("")) != "")
        .groupBy("program")
        .agg(F.count(F.lit(1)).alias("designation_count"))
    )
    if strict:
        tokens = materialize(tokens, "tokens")
        known = [*codes.EU_COUNTRY_TOKENS, *codes.EU_THEMATIC_TOKENS]
        require_none(unknown_tokens(tokens, known), "ofac_eu", "unknown programme codes")
    return _country_rows(tokens, codes.EU_COUNTRY_TOKENS, "EU", F.lit(generated))


def load_eu(entities: DataFrame, head: DataFrame) -> DataFrame:
    first = head.first()
    if first is None:
        raise SourceUnavailable("ofac_eu", "root element is not an export")
    guard(head, "ofac_eu", [Guard("export lacks its generation date", F.col("generated").isNull())])
    guard(entities, "ofac_eu", [], empty="export has no entities")
    return normalize_eu(entities, first["generated"])


SANCTIONS_CONTRACT = Contract(
    "ofac_eu",
    {
        "iso3": non_null("string", matches("^[A-Z]{3}$")),
        "country_name": non_null("string", isin(list(codes.COUNTRY_NAMES.values()))),
        "program": non_null("string", length(1)),
        "list_source": non_null("string", isin(["OFAC", "EU"])),
        "designation_count": non_null("bigint", ge(1)),
        "list_generated_at": nullable("timestamp"),
    },
    unique=("list_source", "program", "iso3"),
)


def combine_lists(us: DataFrame, eu: DataFrame, strict: bool = True) -> DataFrame:
    """Both lists with the seven jurisdictions every refresh must contain."""
    out = us.unionByName(eu)
    if strict:
        floor = small_table(out.sparkSession, [(c,) for c in codes.SANCTION_FLOOR], "member string")
        require_none(missing_members(out, "iso3", floor, "member"), "ofac_eu", "jurisdiction absent")
        SANCTIONS_CONTRACT.enforce(out)
    return out.orderBy("list_source", "iso3", "program")
