"""Spelling variants of a corpus vocabulary: one-edit neighbours over a reduced alphabet.

Letters are hashed to a few symbols. Words one edit apart have reduced words at most one
edit apart, so the full one-edit neighbourhood of every reduced word, joined with the
reduced vocabulary, holds every pair; candidates are verified on the words themselves.
The neighbourhood over a few symbols is small, the one over the real alphabet is not.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.llm.common import mix64, table_columns, utf8
from basinframe.llm.repeats import stored

_LETTERS = "[A-Za-zÀ-ÿ]"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Words a task counts before it passes its counts on; never changes results.
_HELD = 300_000


def word_counts(
    docs: DataFrame, least: int = 7, noise: int = 31, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Occurrences (word, n) of the words of all whole texts.

    Runs of letters are lower-cased (A to Z alone). Where ``noise`` divides the checksum h
    of "id:run", the run's code point h modulo its length is deleted. Words under ``least``
    code points are left out. Tasks count before the shuffle, so that a word which makes up
    a third of a corpus arrives as a few rows.
    """
    rows = table_columns(docs, id=id_col, text=text_col).where("text is not null")
    rows = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), utf8("text").alias("text"))
    pattern = re.compile(_LETTERS + "{%d,}" % least)

    def batch_of(counts):
        columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    def run(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                own: dict[str, int] = {}
                for w in pattern.findall(text.as_py().lower().decode("utf-8", "replace")):
                    own[w] = own.get(w, 0) + 1
                head = zlib.crc32(f"{id_.as_py()}:".encode())
                for w, n in own.items():
                    h = zlib.crc32(w.encode(), head)
                    if h % noise == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least:
                            continue
                    counts[w] = counts.get(w, 0) + n
                if len(counts) > _HELD:
                    yield batch_of(counts)
                    counts = {}
        yield batch_of(counts)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _by_length(words: Sequence[str]):
    """(length, places of the words of that length, their code points as a matrix)."""
    lens = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    begin = np.cumsum(lens) - lens
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        yield int(n), at, flat[begin[at][:, None] + np.arange(n)]


def _reduce(points: np.ndarray, symbols: int | None) -> np.ndarray:
    """Symbols from 1 of code points, hashed to ``symbols`` many; None keeps them apart."""
    if symbols is None:
        return points.astype(np.uint64) + np.uint64(1)
    return mix64(points.astype(np.uint64)) % np.uint64(symbols) + np.uint64(1)


def _sums(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base, and prefix sums of the words' polynomial hashes."""
    width = sym.shape[1]
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(width, _BASE)]), dtype=np.uint64)
    before = np.zeros((len(sym), width + 1), np.uint64)
    np.cumsum(sym * power[:width], axis=1, dtype=np.uint64, out=before[:, 1:])
    return power, before, before[:, -1]


def _key(total: np.ndarray, length: int) -> np.ndarray:
    return mix64(total ^ mix64(np.full(1, length, np.uint64))).view(np.int64)


def reduced_keys(words: Sequence[str], symbols: int | None) -> np.ndarray:
    """Key of each word's reduced word."""
    out = np.zeros(len(words), np.int64)
    for n, at, points in _by_length(words):
        out[at] = _key(_sums(_reduce(points, symbols))[2], n)
    return out


def neighbour_keys(words: Sequence[str], symbols: int | None, alphabet: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, key) of each reduced word's one-edit neighbourhood, itself included.

    ``alphabet`` are the code points whose symbols may be put in. Each key comes once a word.
    """
    found = []
    put = np.unique(_reduce(np.array(alphabet, np.uint32), symbols))
    for n, at, points in _by_length(words):
        sym = _reduce(points, symbols)
        power, before, total = _sums(sym)
        after = total[:, None] - before
        put_in = put[None, None, :] * power[None, : n + 1, None]
        same = [total[:, None]]
        same.append((total[:, None, None] - (sym * power[:n])[:, :, None] + put_in[:, :n]).reshape(len(at), -1))
        shorter = before[:, :n] + after[:, 1:] * _BACK
        longer = (before[:, :, None] + put_in + (after * _BASE)[:, :, None]).reshape(len(at), -1)
        keys = [_key(np.concatenate(same, axis=1), n), _key(shorter, n - 1), _key(longer, n + 1)]
        keys = np.sort(np.concatenate(keys, axis=1), axis=1)
        fresh = np.ones(keys.shape, bool)
        fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
        found.append((np.repeat(at, fresh.sum(axis=1)), keys[fresh]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _coded(words: DataFrame, symbols: int | None) -> DataFrame:
    """Words (word, n) with the key ``r`` of their reduced word."""

    def run(batches):
        for batch in batches:
            keys = reduced_keys(batch.column(0).to_pylist(), symbols)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=["word", "n", "r"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, r long")


def _reduced_pairs(coded: DataFrame, symbols: int | None, alphabet: Sequence[int], slab: int = 4096) -> DataFrame:
    """Keys (a, b) with a <= b of reduced words at most one edit apart, from one end each.

    Different reduced words with one key keep a representative each, so that none is lost.
    """
    if symbols is None:
        some = coded.select("word", "r")
    else:
        table = {c: chr(97 + k) for c, k in zip(alphabet, _reduce(np.array(alphabet, np.uint32), symbols).tolist())}
        letters = "".join(map(chr, table)), "".join(table.values())
        some = coded.groupBy(F.translate("word", *letters).alias("reduced")).agg(F.min("word").alias("word"), F.min("r").alias("r"))
        some = some.select("word", "r")

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, slab):
                part = batch.slice(low, slab)
                own = part.column(1).to_numpy()
                at, keys = neighbour_keys(part.column(0).to_pylist(), symbols, alphabet)
                a, up = own[at], keys >= own[at]
                yield pa.RecordBatch.from_arrays([pa.array(a[up]), pa.array(keys[up])], names=["a", "b"])

    return some.mapInArrow(run, "a long, b long")


def near_pairs(
    words: DataFrame, alphabet: Sequence[int], levels: Sequence[int | None] = (8, 32, None), crowd: int = 500
) -> DataFrame:
    """All pairs (word, n, other, other_n) of words that differ by one edit, each once.

    Words whose reduced word is shared by over ``crowd`` words, and the words next to
    these, go on to the next of ``levels``, a finer alphabet (None: the real one, where
    candidates are the pairs themselves), so that no reduced word becomes a task of
    its own; nothing is capped.
    """
    found: DataFrame | None = None
    for level, symbols in enumerate(levels):
        coded = stored(_coded(words, symbols), "coded")
        pairs = _reduced_pairs(coded, symbols, alphabet)
        many = coded.groupBy("r").count().where(F.col("count") > crowd).select("r")
        last = symbols is None or level == len(levels) - 1
        crowded = not last and not (many := stored(many, "crowded")).isEmpty()
        light = coded.join(many, "r", "left_anti") if crowded else coded
        left = light.select(F.col("r").alias("a"), "word", "n")
        right = light.select(F.col("r").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"))
        near = pairs.join(right, "b").join(left, "a").where((F.col("a") != F.col("b")) | (F.col("word") < F.col("other")))
        near = near.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")
        near = stored(near, "near")
        found = near if found is None else found.unionByName(near)
        if not crowded:
            break
        beside = pairs.join(many.withColumnRenamed("r", "b"), "b").select(F.col("a").alias("r"))
        beside = beside.union(pairs.join(many.withColumnRenamed("r", "a"), "a").select("b")).union(many)
        words = stored(coded.join(beside.distinct(), "r", "left_semi").select("word", "n"), "finer")
    if level:
        # A pair of the finer level may have stood in two light groups as well.
        word, other = F.least("word", "other"), F.greatest("word", "other")
        flip = F.col("word") > F.col("other")
        n, other_n = F.when(flip, F.col("other_n")).otherwise(F.col("n")), F.when(flip, F.col("n")).otherwise(F.col("other_n"))
        found = found.select(word.alias("word"), n.alias("n"), other.alias("other"), other_n.alias("other_n")).distinct()
    return found


def _roots(out: DataFrame) -> DataFrame:
    """(word, root) of words with a form, following forms to the last by doubling.

    A form stands at least ten times as often as its word, so chains have under 20 links
    and five rounds are enough for any corpus.
    """
    links = stored(out.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if links.join(ahead, "root", "left_semi").isEmpty():
            return links
        step = links.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        links = stored(step, "links")


def spelling_variants(
    docs: DataFrame,
    least: int = 7,
    least_n: int = 2,
    ratio: int = 10,
    noise: int = 31,
    levels: Sequence[int | None] = (8, 32, None),
    crowd: int = 500,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of the vocabulary of all documents.

    Words (see :func:`word_counts`) with ``least_n`` occurrences or more are near if they
    differ by one inserted, deleted or replaced code point. ``form`` is the near word of
    largest n, of equals the least in code-point order, if it stands ``ratio`` times as
    often or more, else null; ``root`` is where forms lead from the word, itself without
    one. Null texts give no words, a null id counts as an empty one, repeated rows count as
    often as they stand there; no documents give no rows. Long texts are counted in place;
    other columns are ignored.
    """
    words = stored(word_counts(docs, least, noise, id_col, text_col).where(F.col("n") >= least_n), "words")
    alphabet = [ord(c) for c in map(chr, range(97, 123))] + list(range(0xC0, 0x100))
    pairs = near_pairs(words, alphabet, levels, crowd)
    swapped = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = pairs.unionByName(swapped).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    often = -F.col("best.less") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select(
        "word",
        F.when(often, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, -F.col("best.less")).alias("form_n"),
    )
    out = stored(out, "variants")
    joined = out.join(_roots(out), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
