"""Ordered computations that never put one key's rows into one task.

A window partitioned by a series, fold or province sends each of them to a
single task, and a window with no partition key sends everything to one. Here
the rows are range-partitioned on (key, order) first, so a hot key spans many
partitions; each partition is summarised to one row per key, and the summaries
of the earlier partitions give every partition its starting point.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinframe.session import materialize, shuffle_width

_PART, _RN = "__part", "__rn"


def _sort(order: Sequence[str]) -> list[Column]:
    """``"-name"`` sorts descending; nulls go last either way."""
    return [
        F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last()
        for c in order
    ]


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, str] | None = None,
    maxes: Mapping[str, str] | None = None,
    lags: Mapping[str, str] | None = None,
    ordinal: str | None = None,
    label: str = "prefix",
) -> DataFrame:
    """Add values taken from the rows before each row of the same key.

    ``sums`` / ``maxes`` / ``lags`` map a new column to the source column it is
    the running total, running maximum or previous value of (own row excluded);
    a total with nothing before it is 0, a maximum or lag is NULL. ``ordinal``
    names a 1-based position. ``order`` must be unique within a key.
    """
    sums, maxes, lags = dict(sums or {}), dict(maxes or {}), dict(lags or {})
    keys = list(keys)
    parts = materialize(
        df.repartitionByRange(
            shuffle_width(df.sparkSession), *[F.col(k) for k in keys], *_sort(order)
        ).withColumn(_PART, F.spark_partition_id()),
        label,
    )
    near = Window.partitionBy(_PART, *keys).orderBy(*_sort(order))
    before = near.rowsBetween(Window.unboundedPreceding, -1)
    local = parts.withColumn(_RN, F.row_number().over(near))
    for out, src in sums.items():
        local = local.withColumn(f"__s_{out}", F.coalesce(F.sum(src).over(before), F.lit(0)))
    for out, src in maxes.items():
        local = local.withColumn(f"__m_{out}", F.max(src).over(before))
    if lags:
        local = local.withColumn(
            "__l", F.lag(F.struct(*[F.col(s).alias(o) for o, s in lags.items()])).over(near)
        )

    aggs = [F.count(F.lit(1)).alias("__n")]
    aggs += [F.sum(src).alias(f"__ts_{out}") for out, src in sums.items()]
    aggs += [F.max(src).alias(f"__tm_{out}") for out, src in maxes.items()]
    if lags:
        last = F.struct(*[F.col(s).alias(o) for o, s in lags.items()])
        aggs.append(F.max_by(last, F.col(_RN)).alias("__tl"))
    totals = (local if lags else parts).groupBy(_PART, *keys).agg(*aggs)

    # At most one row per range partition for any key.
    chain = Window.partitionBy(*keys, F.lit(0)).orderBy(_PART)
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__cn")]
    carry += [
        F.coalesce(F.sum(f"__ts_{o}").over(earlier), F.lit(0)).alias(f"__cs_{o}") for o in sums
    ]
    carry += [F.max(f"__tm_{o}").over(earlier).alias(f"__cm_{o}") for o in maxes]
    if lags:
        carry.append(F.lag("__tl").over(chain).alias("__cl"))
    starts = totals.select(_PART, *keys, *carry)

    on = F.col(f"a.{_PART}") == F.col(f"b.{_PART}")
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = local.alias("a").join(starts.alias("b"), on)
    out = [F.col(f"a.{c}") for c in df.columns]
    if ordinal:
        out.append((F.col(f"a.{_RN}") + F.col("b.__cn")).cast("long").alias(ordinal))
    out += [(F.col(f"a.__s_{o}") + F.col(f"b.__cs_{o}")).alias(o) for o in sums]
    out += [F.greatest(F.col(f"a.__m_{o}"), F.col(f"b.__cm_{o}")).alias(o) for o in maxes]
    for o in lags:
        out.append(
            F.when(F.col(f"a.{_RN}") == 1, F.col(f"b.__cl.{o}"))
            .otherwise(F.col(f"a.__l.{o}"))
            .alias(o)
        )
    return joined.select(*out)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of every key. The rank filter is applied before the
    shuffle (window group limit), so a hot key sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*_sort(order))
    return df.withColumn(_RN, F.row_number().over(w)).where(F.col(_RN) <= n).drop(_RN)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Earliest row of each key, combined map-side (no sort, no window)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("__r")
    )
    return picked.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*df.columns)
