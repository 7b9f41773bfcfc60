"""Screens around a block and the rule verdict on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinframe.functions.codes import (
    MIN_CITATION_COVERAGE,
    OVERLAP_CONDITIONAL,
    OVERLAP_NO_GO,
    P_POSITIVE_CONDITIONAL,
)
from basinframe.operators.series import latest_batch


def governance(scores: DataFrame, indicators: list[str]) -> DataFrame:
    """Newest year per country, indicators as columns, three decimals."""
    newest = latest_batch(scores, "year", ["iso3"])
    return newest.groupBy("iso3", "year").agg(
        *[
            F.round(F.max(F.when(F.col("indicator") == i, F.col("value"))), 3).alias(
                i.lower().replace(".", "_")
            )
            for i in indicators
        ]
    )


def with_second_index(gov: DataFrame, index: DataFrame | None) -> DataFrame:
    """Newest value of an optional second index beside the governance scores."""
    if index is None:
        return gov.withColumns(
            {"fsi_total": F.lit(None).cast("double"), "fsi_year": F.lit(None).cast("int")}
        )
    last = index.groupBy("iso3").agg(F.max_by(F.struct("total", "year"), F.col("year")).alias("l"))
    last = last.select(
        "iso3", F.round("l.total", 1).alias("fsi_total"), F.col("l.year").alias("fsi_year")
    )
    return gov.join(last, "iso3", "left")


def sanctions_screen(blocks: DataFrame, programs: DataFrame, block_id: str = "block_id") -> DataFrame:
    """``sanctioned``, programmes and lists per block, matched on country code or on
    country name. The list is gathered per code and per name first (a few hundred rows),
    so blocks meet one row each way and are not shuffled while the list is small."""
    places = blocks.select(
        block_id, F.upper("iso3").alias("iso3"), F.lower("country_name").alias("name")
    )
    listed = programs.select(
        "iso3", F.lower("country_name").alias("name"), "program", "list_source"
    ).distinct()

    def gathered(key: str) -> DataFrame:
        # One country has a few dozen programmes at most.
        return listed.groupBy(key).agg(
            F.collect_set("program").alias(f"{key}_programs"), F.collect_set("list_source").alias(f"{key}_lists")
        )

    hits = places.join(gathered("iso3"), "iso3", "left").join(gathered("name"), "name", "left")
    none = F.array().cast("array<string>")
    both = lambda c: F.array_sort(F.array_union(F.coalesce(f"iso3_{c}", none), F.coalesce(f"name_{c}", none)))
    return hits.select(
        block_id,
        (F.col("iso3_programs").isNotNull() | F.col("name_programs").isNotNull()).alias("sanctioned"),
        both("programs").alias("programs"),
        both("lists").alias("lists"),
    )


def financing_screen(rows: DataFrame, flag: str = "upstream_oil_excluded") -> DataFrame:
    restricts = F.lower(F.trim(flag)).isin("true", "partial")
    return rows.agg(
        F.count(F.lit(1)).alias("n_checked"), F.count_if(restricts).alias("n_restricting")
    )


def financing_rows(rows: DataFrame, flag: str = "upstream_oil_excluded") -> DataFrame:
    return rows.where(F.lower(F.trim(flag)).isin("true", "partial"))


def fiscal_rates(regimes: DataFrame, policy: str = "published") -> DataFrame:
    """Rates used by the economics.

    ``published`` reads ``mapped_*`` and falls back to the regime's own rates, which
    is how the published numbers came about; ``suggested`` prefers the suggested
    rates where a regime states them.
    """
    royalty = [F.col("mapped_royalty_rate"), F.col("royalty_rate")]
    cit = [F.col("mapped_cit_rate"), F.col("cit_rate")]
    if policy == "suggested":
        royalty.insert(0, F.col("suggested_royalty_rate"))
        cit.insert(0, F.col("suggested_cit_rate"))
    elif policy != "published":
        raise ValueError(policy)
    return regimes.select(
        "iso3",
        F.coalesce(*royalty, F.lit(0.0)).alias("royalty_rate"),
        F.coalesce(*cit).alias("cit_rate"),
    )


def verdict(sanctioned, overlap_pct, emv, p_positive) -> Column:
    s, o, e, p = (F.col(c) if isinstance(c, str) else c for c in (sanctioned, overlap_pct, emv, p_positive))
    return (
        F.when(e.isNull() | p.isNull(), F.lit(None).cast("string"))
        .when(s | (o > OVERLAP_NO_GO) | (e <= 0), "NO_GO")
        .when((p < P_POSITIVE_CONDITIONAL) | (o > OVERLAP_CONDITIONAL), "CONDITIONAL")
        .otherwise("GO")
    )


def verdict_basis(blocks: DataFrame) -> DataFrame:
    """Missing overlap counts as 0 and missing sanctions as none, and both are
    reported as gaps beside the verdict."""
    gaps = F.filter(
        F.array(
            F.when(F.col("overlap_pct").isNull(), F.lit("overlap")),
            F.when(F.col("sanctioned").isNull(), F.lit("sanctions")),
            F.when(F.col("emv_musd").isNull(), F.lit("economics")),
        ),
        lambda g: g.isNotNull(),
    )
    return blocks.withColumns(
        {
            "data_gaps": gaps,
            "overlap_pct": F.coalesce("overlap_pct", F.lit(0.0)),
            "sanctioned": F.coalesce("sanctioned", F.lit(False)),
        }
    )


def decide(blocks: DataFrame) -> DataFrame:
    return verdict_basis(blocks).withColumn(
        "verdict", verdict("sanctioned", "overlap_pct", "emv_musd", "p_emv_positive")
    )


# ---- cited fields ------------------------------------------------------------------------


def gap_rows(blocks: DataFrame, screen: DataFrame, block_id: str, agent: str, need: str) -> DataFrame:
    """A stated gap for every block the screen has nothing for; never a value."""
    joined = blocks.select(block_id).join(screen.select(block_id, need), block_id, "left")
    return joined.where(F.col(need).isNull()).select(
        block_id,
        F.lit(agent).alias("agent"),
        F.lit("data_gap").alias("field"),
        F.lit(f"{need} missing").alias("value"),
        F.array(F.lit("snapshot")).alias("source_ids"),
    )


def citation_coverage(fields: DataFrame, block_id: str) -> DataFrame:
    """Share of a block's fields that name a source."""
    cited = F.coalesce((F.size("source_ids") > 0).cast("double"), F.lit(0.0))
    return fields.groupBy(block_id).agg(F.avg(cited).alias("coverage"))


def coverage_gate(blocks: DataFrame, coverage: DataFrame, block_id: str) -> DataFrame:
    """Blocks with no field count as fully cited; below the minimum is rejected."""
    c = F.coalesce("coverage", F.lit(1.0))
    return blocks.join(coverage, block_id, "left").withColumns(
        {
            "coverage": c,
            "rejected": F.when(c < MIN_CITATION_COVERAGE, "citation coverage below minimum"),
        }
    )


def citation_appendix(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Source and the sorted distinct fields that cite it, one row per pair first so
    that a popular source is deduplicated before it is gathered."""
    pairs = fields.select(
        *keys,
        F.explode("source_ids").alias("source"),
        F.concat_ws(".", "agent", "field").alias("cited_by"),
    ).distinct()
    return pairs.groupBy(*keys, "source").agg(
        F.array_join(F.array_sort(F.collect_list("cited_by")), ", ").alias("cited_by")
    )


def quant_hash(columns: dict[str, Column]) -> Column:
    """SHA-256 of a canonical JSON object with sorted keys; prose stays outside it."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])), 256)


def memo_rollup(memos: DataFrame) -> DataFrame:
    """pass when every memo has its coverage and its counter-argument, else fail;
    empty when there is none."""
    ok = (F.col("citation_coverage") >= MIN_CITATION_COVERAGE) & (
        F.length(F.trim(F.coalesce("redteam_narrative", F.lit("")))) > 0
    )
    return memos.agg(F.count(F.lit(1)).alias("n_memos"), F.bool_and(ok).alias("__ok")).select(
        "n_memos",
        F.when(F.col("n_memos") == 0, "empty").when(F.col("__ok"), "pass").otherwise("fail").alias("overall"),
    )


def memo_listing(memos: DataFrame) -> DataFrame:
    """Flat view of nested memo records."""
    m = "memo."
    return memos.select(
        F.col(m + "block_id"),
        F.col(m + "verdict"),
        F.col(m + "verdict_basis.emv_musd"),
        F.col(m + "generated_at"),
        F.col(m + "citation_coverage"),
        "narrator",
    )
