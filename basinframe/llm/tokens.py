"""Token counts: pieces once per distinct pre-token of all texts, joined to the documents' frequencies."""

from __future__ import annotations

import os
from collections import Counter
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.llm.common import chunks, id_ddl, table_columns, utf8
from basinframe.llm.repeats import stored

#: Pre-tokens a task gathers before it passes their counts on, and their bytes.
_HELD, _HELD_BYTES = 200_000, 16 << 20
#: Longer pre-tokens are joined by a digest.
_LONG = 32


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def count_pieces(words: list[bytes], path: str) -> list[int]:
    """Tokens of each pre-token; bytes that are not UTF-8 read as the replacement character."""
    encoded = _tokenizer(path).encode_batch_fast([w.decode(errors="replace") for w in words], add_special_tokens=False)
    return list(map(len, encoded))


def join_key(word: bytes) -> bytes:
    """The pre-token, or for a long one a space (no pre-token has any) and its digest of 128 bits."""
    return word if len(word) <= _LONG else b" " + xxhash.xxh3_128_digest(word)


def _frequencies(batches):
    """(w, f): pre-tokens of a task's texts with their counts, passed on whenever many are held."""

    def flush(held):
        return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(held.values(), pa.int64())], names=["w", "f"])

    held, size = Counter(), 0
    for batch in batches:
        for part in chunks(batch, 2 << 20, 0):
            for text in part.column(0).to_pylist():
                held.update(text.split())
                size += len(text)
                if len(held) > _HELD or (size > _HELD_BYTES and sum(map(len, held)) > _HELD_BYTES):
                    yield flush(held)
                    held, size = Counter(), 0
    yield flush(held)


def pretoken_table(texts: DataFrame, path: str) -> DataFrame:
    """(k, f, pieces): each distinct pre-token of the column of bytes once: its join key, how
    often it occurs, and its tokens. No texts give no rows."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            keys = pa.array(list(map(join_key, words)), pa.binary())
            pieces = [n for at in range(0, len(words), 4096) for n in count_pieces(words[at : at + 4096], path)]
            yield pa.RecordBatch.from_arrays([keys, batch.column(1), pa.array(pieces, pa.int64())], names=["k", "f", "pieces"])

    totals = texts.mapInArrow(_frequencies, "w binary, f long").groupBy("w").agg(F.sum("f").alias("f"))
    return totals.mapInArrow(run, "k binary, f long, pieces long")


def _bags(rows: DataFrame, frequent: dict[bytes, int]) -> DataFrame:
    """(_id, _row, n_bytes, near, rest): the tokens of a text's frequent pre-tokens, and the
    key and frequency of each of its other distinct ones."""
    known = frequent.get

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 2 << 20):
                texts = part.column(1).to_pylist()
                near, ends, keys, times = [], [0], [], []
                for text in texts:
                    total = 0
                    for word, n in Counter(text.split()).items():
                        key = word if len(word) <= _LONG else join_key(word)
                        pieces = known(key)
                        if pieces is None:
                            keys.append(key)
                            times.append(n)
                        else:
                            total += n * pieces
                    near.append(total)
                    ends.append(len(keys))
                rest = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(times, pa.int64())], names=["k", "n"])
                sizes = pa.array([len(t) for t in texts], pa.int64())
                columns = [part.column(0), part.column(2), sizes, pa.array(near, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_row", "n_bytes", "near", "rest"])

    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, f"{id_ddl(rows, '_id')}, _row long, n_bytes long, near long, rest array<struct<k: binary, n: long>>")


def token_counts(
    docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1 << 16
) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed ``limit``.

    A text's pre-tokens are its runs of bytes between ASCII white space, which no token
    of a tokenizer that drops white space can cross. The distinct pre-tokens of all texts
    form a table, in which each one's pieces are counted once. It is joined to the
    frequencies of every document, and the products are summed per row. The ``frequent``
    most frequent pre-tokens (a bound, about 3 MB) are joined inside the tasks, so what is
    shuffled is the rare rest, and no pre-token of it holds more than 1 / ``frequent`` of
    all occurrences. ``path`` names a ``tokenizers`` file whose normaliser or pre-tokenizer
    drops white space; strings of its special tokens count as the library counts them.

    One row per input row: repeated rows repeat, a null or empty text has no bytes and no
    tokens, a null id stays null, no rows give no rows. Very long texts are one bag of
    their distinct pre-tokens. Of equally frequent pre-tokens it makes no difference which
    are joined where. Bytes that are not UTF-8 count as the replacement character in tokens
    and as they are in bytes. Other columns are ignored, whatever their names.
    """
    rows = table_columns(docs, _id=id_col, _text=text_col).withColumn("_text", utf8("_text"))
    table = stored(pretoken_table(rows.select("_text"), path), "pretokens")
    top = table.orderBy(F.desc("f"), "k").limit(frequent).select("k", "pieces").toArrow()
    near = dict(zip(top["k"].to_pylist(), top["pieces"].to_pylist(), strict=True))
    bags = stored(_bags(rows, near), "bags")
    rare = bags.select("_row", F.explode("rest").alias("e")).select("_row", "e.k", "e.n")
    far = rare.join(table.select("k", "pieces"), "k").groupBy("_row").agg(F.sum(F.col("n") * F.col("pieces")).alias("far"))
    n = F.col("near") + F.coalesce("far", F.lit(0))
    out = bags.drop("rest").join(far, "_row", "left").withColumn("n_tokens", n)
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
