"""Declarative table contracts, evaluated in one aggregate pass."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinframe.errors import ContractViolation, DataError, SourceUnavailable

#: The four columns every stored table carries.
PROVENANCE_COLUMNS = ["source_id", "retrieved_at", "source_url", "transform_version"]

SAMPLE_ROWS = 10


@dataclass(frozen=True)
class Check:
    """A named predicate over one column; NULLs are the nullability check's job."""

    name: str
    holds: Callable[[Column], Column]


def isin(values: Sequence) -> Check:
    return Check("isin", lambda c: c.isin(list(values)))


def in_range(lo, hi) -> Check:
    return Check("in_range", lambda c: c.between(lo, hi))


def ge(bound) -> Check:
    return Check("ge", lambda c: c >= bound)


def gt(bound) -> Check:
    return Check("gt", lambda c: c > bound)


def eq(value) -> Check:
    return Check("eq", lambda c: c == F.lit(value))


def matches(pattern: str) -> Check:
    return Check("matches", lambda c: c.rlike(pattern))


def startswith(prefix: str) -> Check:
    return Check("startswith", lambda c: c.startswith(prefix))


def not_startswith(prefix: str) -> Check:
    return Check("not_startswith", lambda c: ~c.startswith(prefix))


def length(lo: int, hi: int | None = None) -> Check:
    return Check(
        "length", lambda c: (F.length(c) >= lo) & (F.lit(True) if hi is None else F.length(c) <= hi)
    )


@dataclass(frozen=True)
class Field:
    type: str
    nullable: bool = False
    checks: tuple[Check, ...] = ()


@dataclass(frozen=True)
class Monotone:
    """``column`` must not fall as ``order`` rises within ``group``."""

    name: str
    group: tuple[str, ...]
    order: str
    column: str


def non_null(type: str, *checks: Check) -> Field:
    return Field(type, False, checks)


def nullable(type: str, *checks: Check) -> Field:
    return Field(type, True, checks)


@dataclass(frozen=True)
class Contract:
    source_id: str
    fields: dict[str, Field]
    unique: tuple[str, ...] = ()
    row_checks: dict[str, Callable[[], Column]] = field(default_factory=dict)
    monotone: tuple[Monotone, ...] = ()

    def with_provenance(self) -> Contract:
        extra = {
            "source_id": non_null("string", length(1)),
            "retrieved_at": non_null("timestamp"),
            "source_url": non_null("string", length(1)),
            "transform_version": non_null("string", length(1)),
        }
        return Contract(
            self.source_id, {**self.fields, **extra}, self.unique, self.row_checks, self.monotone
        )

    def coerce(self, df: DataFrame) -> DataFrame:
        """Cast to the declared types; a value that cannot be cast becomes NULL
        and then fails the nullability check."""
        require_columns(df, list(self.fields), self.source_id)
        return df.select(*[F.col(n).try_cast(f.type).alias(n) for n, f in self.fields.items()])

    def broken(self) -> dict[str, Column]:
        """``column:check`` -> predicate that is true on an offending row."""
        out: dict[str, Column] = {}
        for name, spec in self.fields.items():
            c = F.col(name)
            if not spec.nullable:
                out[f"{name}:not_null"] = c.isNull()
            if spec.type == "double":
                out[f"{name}:not_nan"] = F.coalesce(F.isnan(c), F.lit(False))
            for check in spec.checks:
                out[f"{name}:{check.name}"] = ~F.coalesce(check.holds(c), F.lit(True))
        for name, predicate in self.row_checks.items():
            out[f"row:{name}"] = ~F.coalesce(predicate(), F.lit(False))
        return out

    def failures(self, df: DataFrame) -> DataFrame:
        """``(check, n_failed)`` for every check, zero counts included."""
        preds = self.broken()
        totals = df.agg(*[F.count_if(p).alias(n) for n, p in preds.items()])
        out = totals.unpivot([], list(preds), "check", "n_failed")
        if self.unique:
            out = out.unionByName(
                duplicate_keys(df, self.unique)
                .agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_failed"))
                .select(F.lit("unique:" + ",".join(self.unique)).alias("check"), "n_failed")
            )
        for rule in self.monotone:
            out = out.unionByName(
                _falls(df, rule).select(F.lit(f"group:{rule.name}").alias("check"), "n_failed")
            )
        return out

    def offending(self, df: DataFrame) -> DataFrame:
        """Rows failing any row-level check, with the names of what failed."""
        named = F.filter(
            F.array(*[F.when(p, F.lit(n)) for n, p in self.broken().items()]),
            lambda x: x.isNotNull(),
        )
        return df.withColumn("failed_checks", named).where(F.size("failed_checks") > 0)

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(good rows, bad rows with ``failed_checks``). All rows of a repeated key are
        bad, and so is a row that falls behind its group's order."""
        named = [F.when(p, F.lit(n)) for n, p in self.broken().items()]
        tagged = df
        if self.unique:
            again = duplicate_keys(df, self.unique).select(*[F.col(c).alias(f"__k_{c}") for c in self.unique])
            on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in self.unique])
            tagged = tagged.join(again.withColumn("__again", F.lit(True)), on, "left").drop(*[f"__k_{c}" for c in self.unique])
            named.append(F.when(F.col("__again"), F.lit("unique:" + ",".join(self.unique))))
        for i, rule in enumerate(self.monotone):
            w = Window.partitionBy(*rule.group).orderBy(rule.order)
            tagged = tagged.withColumn(f"__falls{i}", F.col(rule.column) < F.lag(rule.column).over(w))
            named.append(F.when(F.col(f"__falls{i}"), F.lit(f"group:{rule.name}")))
        tagged = tagged.withColumn("failed_checks", F.filter(F.array(*named), lambda x: x.isNotNull()))
        good = tagged.where(F.size("failed_checks") == 0).select(*df.columns)
        return good, tagged.where(F.size("failed_checks") > 0).select(*df.columns, "failed_checks")

    def enforce(self, df: DataFrame) -> DataFrame:
        """Return ``df`` unchanged, or raise with every failing check counted."""
        failing = self.failures(df).where("n_failed > 0").orderBy("check").collect()
        if failing:
            sample = [r.asDict(True) for r in self.offending(df).limit(SAMPLE_ROWS).collect()]
            detail = ", ".join(f"{r['check']}={r['n_failed']}" for r in failing)
            raise ContractViolation(self.source_id, f"{detail}; sample {sample}")
        return df


def _falls(df: DataFrame, rule: Monotone) -> DataFrame:
    w = Window.partitionBy(*rule.group).orderBy(rule.order)
    step = df.withColumn("__prev", F.lag(rule.column).over(w))
    return step.agg(F.count_if(F.col(rule.column) < F.col("__prev")).alias("n_failed"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_columns(df: DataFrame, required: Sequence[str], source_id: str, exc=ContractViolation):
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise exc(source_id, f"missing columns {missing}")


def unknown_codes(df: DataFrame, code: str, known: DataFrame, known_code: str) -> DataFrame:
    """Distinct codes of ``df`` absent from the code map, with their row counts."""
    seen = df.groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n_rows"))
    return seen.join(known.select(F.col(known_code).alias("code")).distinct(), "code", "left_anti")


def missing_members(df: DataFrame, column: str, required: DataFrame, member: str) -> DataFrame:
    """Required members with no row in ``df``."""
    have = df.select(F.col(column).alias(member)).distinct()
    return required.select(member).distinct().join(have, member, "left_anti")


def strict_double(column: str, sentinels: Sequence[str]) -> tuple[Column, Column]:
    """(value, junk flag): listed sentinels are NULL, other text is junk."""
    text = F.trim(F.col(column))
    absent = text.isNull() | text.isin(list(sentinels))
    value = F.when(~absent, text.try_cast("double"))
    return value, ~absent & value.isNull()


def truncated(declared: Column, rows: Column) -> Column:
    """A payload that declares more rows than it carries."""
    return F.coalesce(declared.try_cast("long") > rows, F.lit(False))


def collapse_identical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Identical rows become one; conflicting rows survive to fail the key check."""
    return df.dropDuplicates(list(columns)) if columns else df.dropDuplicates()


def drop_and_count(
    df: DataFrame, by: str, rules: Sequence[tuple[str, Column]]
) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts): a row counts against the first rule it breaks."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(list(rules)):
        reason = F.when(bad, F.lit(name)).otherwise(reason)
    tagged = df.withColumn("__why", reason)
    counts = tagged.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_raw"),
        *[F.count_if(F.col("__why") == n).alias(f"dropped_{n}") for n, _ in rules],
        F.count_if(F.col("__why").isNull()).alias("n_kept"),
    )
    return tagged.where("__why IS NULL").drop("__why"), counts


@dataclass(frozen=True)
class Guard:
    """A load-stopping condition on raw rows. ``allowed`` rows may break it."""

    detail: str
    bad: Column
    exc: type[DataError] = ContractViolation
    allowed: int = 0


def guard(df: DataFrame, source_id: str, rules: Sequence[Guard], empty: str | None = None) -> None:
    """Raise the first broken rule; all of them are counted in one pass."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.coalesce(r.bad, F.lit(False))).alias(f"g{i}") for i, r in enumerate(rules)],
    ).first()
    if empty and row["n"] == 0:
        raise SourceUnavailable(source_id, empty)
    for i, rule in enumerate(rules):
        if row[f"g{i}"] > rule.allowed:
            raise rule.exc(source_id, f"{rule.detail} ({row[f'g{i}']} rows)")


def guard_report(df: DataFrame, by: str, rules: Sequence[Guard], expected: DataFrame | None = None, empty: str = "no rows") -> DataFrame:
    """``by, rule, n_bad, allowed, stops``: every guard counted for all sources at once.

    The conditions are those of :func:`guard`, which stops one load; here each source of
    the column ``by`` gets one row per rule and says whether its load would stop. Members of
    ``expected`` without a row break the rule ``empty``; rows of no source are left out.
    """
    counts = df.where(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.coalesce(r.bad, F.lit(False))).alias(f"g{i}") for i, r in enumerate(rules)],
    )
    if expected is not None:
        counts = expected.select(by).distinct().join(counts, by, "left")
    none = F.when(F.coalesce("n", F.lit(0)) == 0, 1).otherwise(0)
    found = [(empty, none, 0), *[(r.detail, F.coalesce(f"g{i}", F.lit(0)), r.allowed) for i, r in enumerate(rules)]]
    rows = [
        F.struct(F.lit(d).alias("rule"), c.cast("long").alias("n_bad"), F.lit(a).cast("long").alias("allowed"), (c > a).alias("stops"))
        for d, c, a in found
    ]
    return counts.select(by, F.explode(F.array(*rows)).alias("g")).select(by, "g.*")


def require_none(df: DataFrame, source_id: str, detail: str, exc=ContractViolation) -> None:
    """Raise when an anti-join found anything (unknown codes, missing members)."""
    found = df.limit(SAMPLE_ROWS).collect()
    if found:
        raise exc(source_id, f"{detail}: {[tuple(r) for r in found]}")


def require_rows(df: DataFrame, source_id: str, exc=SourceUnavailable) -> DataFrame:
    """An empty result is a failure, never a fresh empty table."""
    if df.isEmpty():
        raise exc(source_id, "no rows; refusing to store an empty table as fresh")
    return df


@dataclass(frozen=True)
class Provenance:
    source_id: str
    retrieved_at: dt.datetime
    source_url: str
    transform_version: str

    def __post_init__(self):
        if self.retrieved_at.tzinfo is None:
            raise ValueError("retrieved_at must carry a time zone")
        for name in ("source_id", "source_url", "transform_version"):
            if not getattr(self, name).strip():
                raise ValueError(f"{name} must not be blank")


def attach_provenance(df: DataFrame, prov: Provenance) -> DataFrame:
    return df.withColumns(
        {
            "source_id": F.lit(prov.source_id),
            "retrieved_at": F.lit(prov.retrieved_at).cast("timestamp"),
            "source_url": F.lit(prov.source_url),
            "transform_version": F.lit(prov.transform_version),
        }
    )


def invalid_provenance() -> Column:
    """True on a row whose four provenance columns are not all usable."""
    blank = [
        F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
        for c in PROVENANCE_COLUMNS
        if c != "retrieved_at"
    ]
    return reduce(lambda a, b: a | b, blank, F.col("retrieved_at").isNull())


def provenance_of(df: DataFrame) -> DataFrame:
    """One row: the provenance carried by a table."""
    return df.select(*PROVENANCE_COLUMNS).limit(1)


def content_hash(df: DataFrame) -> DataFrame:
    """``(n_rows, content_sha256)``, independent of row order and partitioning.

    Row hashes are added up, not xor-ed: duplicate rows must not cancel out.
    """
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    total = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row), F.lit(0)).alias("__h")
    )
    return total.select(
        "n_rows",
        F.sha2(F.concat_ws(":", F.col("n_rows"), F.col("__h").cast("string")), 256).alias(
            "content_sha256"
        ),
    )
