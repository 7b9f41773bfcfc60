"""What exact passage deduplication shares: content-chosen anchors and their recurrences.

A passage is a window of a fixed number of symbols (words or bytes). Every window has an
anchor, the least-hashed of the shorter grams inside it, the leftmost of equals. The
choice depends on the window's content alone, so equal windows have equal anchors at equal
places, and consecutive windows mostly share one: one row stands for a run of windows.
Only runs whose anchor gram recurs can hold a repeated window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinframe.llm.common import chunks, id_ddl, mix64, utf8
from basinframe.session import scratch_path

_BASE = 0x9E3779B97F4A7C15
_SLAB = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
_BYTES = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder, densely packed, and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_symbols(text: bytes) -> np.ndarray:
    return _BYTES[np.frombuffer(text, np.uint8)]


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHashes()


def word_symbols(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_BASE))]), dtype=np.uint64)
    down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))]), dtype=np.uint64)
    return up, down


_UP, _DOWN = _powers(_SLAB + 4096)


def gram_hashes(sym: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` symbols; at most a slab's worth at once."""
    n = len(sym) - gram + 1
    sums = np.concatenate([[np.uint64(0)], np.cumsum(sym * _UP[: len(sym)], dtype=np.uint64)])
    return mix64((sums[gram:] - sums[:n]) * _DOWN[:n])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    rest = width - step
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def anchor_runs(syms: Sequence[np.ndarray], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with one anchor: (text, first window, windows, gram hash)."""
    lens = np.fromiter(map(len, syms), np.int64, len(syms))
    ends = np.cumsum(lens)
    out: list[tuple[np.ndarray, ...]] = []
    flat = np.concatenate([*syms, np.zeros(0, np.uint64)])
    owner = np.repeat(np.arange(len(syms)), lens)
    for low in range(0, len(flat) - window + 1, _SLAB):
        part = flat[low : low + _SLAB + window - 1]
        h = gram_hashes(part, gram)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_min(key, window - gram + 1) & _PLACE).astype(np.int64)
        start = np.arange(low, low + len(place))
        valid = start + window <= ends[owner[start]]
        fresh = np.append(True, (place[1:] != place[:-1]) | ~valid[:-1] | (owner[start[1:]] != owner[start[:-1]]))
        first = np.flatnonzero(valid & fresh)
        if len(first):
            # A run goes on to the next one or to the last valid window before it.
            count = np.add.reduceat(valid.astype(np.int64), first)
            text = owner[start[first]]
            out.append((text, start[first] - (ends - lens)[text], count, h[place[first]].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _text, _d): rows are told apart by the hash of their id and text."""
    rows = docs.select(F.col(id_col).alias("_id"), utf8(text_col).alias("_text"))
    return rows.withColumn("_d", F.xxhash64("_id", "_text"))


def find_anchors(
    rows: DataFrame, symbols: Callable[[bytes], np.ndarray], window: int, gram: int, with_id: bool
) -> DataFrame:
    """One row (_d, g, lo, n, and _id if asked for) per run of windows with one anchor."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 2 << 20):
                text, lo, n, g = anchor_runs([symbols(t) for t in part.column(1).to_pylist()], window, gram)
                at = pa.array(text)
                columns = [part.column(2).take(at), pa.array(g), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))]
                own = [part.column(0).take(at)] if with_id else []
                yield pa.RecordBatch.from_arrays([*columns, *own], names=["_d", "g", "lo", "n", *["_id"] * with_id])

    return rows.mapInArrow(run, "_d long, g long, lo int, n int" + f", {id_ddl(rows, '_id')}" * with_id)


Finish = Callable[[list[bytes], list[list[tuple[int, int]]]], list[pa.Array]]


def candidates(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    symbols: Callable[[bytes], np.ndarray],
    content: Callable[[bytes], Callable[[int, int], bytes]],
    window: int,
    gram: int,
    between_ids: bool,
    finish: Finish,
    finish_ddl: str,
) -> DataFrame:
    """The documents with the runs whose anchor recurs; the others are finished at once.

    Columns: ``_id``, ``_d``, ``_text`` and ``_runs`` (g, hash of the run's content, lo, n)
    for documents with such runs, and the columns of ``finish``, null for these. The
    anchors are stored, counted by hash and joined back to the hashes that recur (between
    ids, or at all); a hash that many share is counted before the shuffle, and its rows
    can be split in the join, whose other side is stored. Texts are shuffled once.
    """
    rows = keyed(docs, id_col, text_col)
    found = stored(find_anchors(rows, symbols, window, gram, between_ids), "anchors")
    if between_ids:
        again = found.groupBy("g").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).where("_first < _last")
    else:
        again = found.groupBy("g").agg(F.count("*").alias("_n")).where("_n > 1")
    again = stored(again.select("g"), "recurring")
    lists = (
        found.join(again, "g")
        .groupBy("_d")
        .agg(F.collect_set(F.struct("g", "lo", "n")).alias("_found"))
        .withColumnRenamed("_d", "_key")
    )
    joined = rows.join(lists, rows["_d"] == lists["_key"], "left").select("_id", "_text", "_d", "_found")
    names = [p.split()[0] for p in finish_ddl.split(", ")]
    runs = "array<struct<g:bigint,w:bigint,lo:int,n:int>>"

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 4 << 20):
                texts, lists = part.column(1).to_pylist(), part.column(3).to_pylist()
                kept, held = [], []
                for t, found in zip(texts, lists, strict=True):
                    kept.append(t if found else None)
                    if not found:
                        held.append(None)
                        continue
                    cut = content(t)
                    for r in found:
                        r["w"] = xxhash.xxh3_64_intdigest(cut(r["lo"], r["lo"] + r["n"] + window - 1)) - (1 << 63)
                    held.append(found)
                done = finish([t if k is None else b"" for t, k in zip(texts, kept)], [[] for _ in texts])
                open_ = pa.array([k is not None for k in kept])
                done = [pa.compute.if_else(open_, pa.nulls(len(texts), c.type), c) for c in done]
                own = pa.struct([("g", pa.int64()), ("w", pa.int64()), ("lo", pa.int32()), ("n", pa.int32())])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(kept, pa.binary()), pa.array(held, pa.list_(own)), *done],
                    names=["_id", "_d", "_text", "_runs", *names],
                )

    schema = f"{id_ddl(rows, '_id')}, _d long, _text binary, _runs {runs}, {finish_ddl}"
    return stored(joined.mapInArrow(run, schema), "candidates")


def finished(found: DataFrame, ranges: DataFrame, id_col: str, finish: Finish, finish_ddl: str) -> DataFrame:
    """Results of all documents; ``ranges`` (_d, start, stop) of symbols go, overlaps are one.

    Texts come back by their key, only those of documents with candidates.
    """
    names = [p.split()[0] for p in finish_ddl.split(", ")]
    lists = ranges.groupBy("_d").agg(F.collect_set(F.struct("start", "stop")).alias("_gone")).withColumnRenamed("_d", "_key")
    open_ = found.where("_text is not null").select("_id", "_text", "_d")
    rows = open_.join(lists, open_["_d"] == lists["_key"], "left").select("_id", "_text", "_gone")

    def merged(spans):
        out: list[list[int]] = []
        for a, b in sorted((s["start"], s["stop"]) for s in spans or ()):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [tuple(s) for s in out]

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 4 << 20):
                spans = [merged(s) for s in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *finish(part.column(1).to_pylist(), spans)], names=["_id", *names])

    late = rows.mapInArrow(run, f"{id_ddl(found, '_id')}, {finish_ddl}")
    soon = found.where("_text is null").select("_id", *names)
    return soon.unionByName(late).withColumnRenamed("_id", id_col)


def run_texts(found: DataFrame, specs: DataFrame, content, window: int, carry: str) -> DataFrame:
    """Contents of chosen runs: ``specs`` has _d, lo, n and the columns of ``carry`` (DDL)."""
    names = [p.split()[0] for p in carry.split(", ")]
    lists = specs.groupBy("_d").agg(F.collect_list(F.struct("lo", "n", *names)).alias("_specs")).withColumnRenamed("_d", "_key")
    texts = found.where("_text is not null").select("_d", "_text").dropDuplicates(["_d"])
    rows = texts.join(lists, texts["_d"] == lists["_key"]).select("_d", "_text", "_specs")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, 2 << 20):
                specs, cuts = [], []
                for text, wanted in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    cut = content(text)
                    for s in wanted:
                        specs.append(s)
                        cuts.append(cut(s["lo"], s["lo"] + s["n"] + window - 1))
                kinds = {f.name: f.type for f in part.schema.field("_specs").type.value_type}
                columns = [pa.array([s[c] for s in specs], kinds[c]) for c in ("n", *names)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cuts, pa.binary())], names=["n", *names, "cut"])

    return rows.mapInArrow(run, f"n int, {carry}, cut binary")


def finer_runs(found: DataFrame, runs: DataFrame, hot: DataFrame, symbols, content, window: int, gram: int) -> DataFrame:
    """The runs of crowded anchors (``hot``: g), cut anew by a longer gram: rows (_d, g, w, lo, n)."""
    specs = runs.join(hot, "g").select("_d", "lo", "n", F.col("_d").alias("d"), F.col("lo").alias("low"))
    cuts = run_texts(found, specs.distinct(), content, window, "d bigint, low int")

    def run(batches):
        for batch in batches:
            texts = batch.column("cut").to_pylist()
            which, lo, n, g = anchor_runs([symbols(t) for t in texts], window, gram)
            cut = [content(t) for t in texts]
            w = [
                xxhash.xxh3_64_intdigest(cut[i](a, a + m + window - 1)) - (1 << 63)
                for i, a, m in zip(which.tolist(), lo.tolist(), n.tolist())
            ]
            at = pa.array(which)
            low = batch.column("low").take(at).to_numpy() + lo
            columns = [batch.column("d").take(at), pa.array(g), pa.array(w, pa.int64())]
            columns += [pa.array(low.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["_d", "g", "w", "lo", "n"])

    return cuts.mapInArrow(run, "_d long, g long, w long, lo int, n int")
