"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Worker-side caches are emptied beyond this many entries; they never change results.
CACHE_WORDS = 600_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def utf8(column: str) -> Column:
    """Text as its bytes, a missing text as no bytes."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def table_columns(df: DataFrame, **names: str) -> DataFrame:
    """The named columns alone, under the names an operator works with, so that no other
    column of the caller can clash with its own."""
    return df.select(*(F.col(f"`{column}`").alias(name) for name, column in names.items()))


def id_ddl(df: DataFrame, column: str) -> str:
    return f"`{column}` {df.schema[column].dataType.simpleString()}"


def chunks(batch: pa.RecordBatch, max_bytes: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts are about ``max_bytes`` long, one row at least."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


class Codes(dict):
    """Numbers for words, in order of first sight."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def per_text(
    df: DataFrame, fn: Callable[[list[bytes]], list[pa.Array]], ddl: str, max_bytes: int = 4 << 20
) -> DataFrame:
    """Apply ``fn`` to the texts of (id, bytes) rows in slices of bounded size.

    ``fn`` gives one array per column of ``ddl``; the id goes in front. One output
    row per input row, no shuffle.
    """
    key, text = df.columns
    schema = f"{id_ddl(df, key)}, {ddl}"
    names = [key, *(part.split()[0] for part in ddl.split(", "))]

    def run(batches):
        for batch in batches:
            for part in chunks(batch, max_bytes):
                yield pa.RecordBatch.from_arrays([part.column(0), *fn(part.column(1).to_pylist())], names=names)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, mask: Callable[[list[bytes]], np.ndarray], max_bytes: int = 4 << 20) -> DataFrame:
    """Whole rows whose text ``mask`` keeps, in slices of bounded size; no shuffle.

    Rows travel as they are, their text once; a null text is shown to ``mask`` as empty.
    """
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in chunks(batch, max_bytes, at):
                texts = part.column(at)
                texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
                yield part.filter(pa.array(mask([t or b"" for t in texts]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, on uint64 arrays."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
