"""Records of large JSON documents, one row each, read in parallel.

A landed document is one JSON value: an array of records, mostly inside an object. A JSON
reader would make it one row of one task. Here a file is split at closing braces, so that
Spark plans byte ranges of it like of any text. A task keeps its range as chunks of bounded
size, one row each, and says what each adds to the nesting. What a chunk cannot know alone,
whether it starts inside a string and how deep it is nested, comes from running totals over
chunks; then each chunk cuts its own records, and only those that cross its ends are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basinframe.errors import SourceUnavailable
from basinframe.operators.contracts import Guard, guard
from basinframe.session import materialize
from basinframe.sources.spec import Feed

#: Bytes of a chunk, unless what one closing brace ends is longer.
_CHUNK = 1 << 19
_PLACE = ["block", "n"]
_QUOTE, _ESCAPE, _OPEN, _CLOSE, _LEFT, _RIGHT = b'"\\{}[]'
_IS_MARK = np.isin(np.arange(256), [_QUOTE, _ESCAPE, _OPEN, _CLOSE, _LEFT, _RIGHT])
_LEVELS = "array<struct<braces: long, brackets: long, starts: long, ends: long>>"
_CASE = f"struct<braces: long, brackets: long, levels: {_LEVELS}>"
_CHUNKS = f"file string, block long, n long, text binary, quotes long, outside {_CASE}, inside {_CASE}"
_CUT = "file string, block long, n long, pos long, head binary, record binary, ended boolean"
_PLACED = {"file": pa.string(), "block": pa.int64(), "n": pa.int64()}
_LEVELS_ARROW = pa.list_(pa.struct({k: pa.int64() for k in ("braces", "brackets", "starts", "ends")}))
_CASE_ARROW = pa.struct({"braces": pa.int64(), "brackets": pa.int64(), "levels": _LEVELS_ARROW})
_CHUNKS_ARROW = pa.schema(
    _PLACED | {"text": pa.binary(), "quotes": pa.int64(), "outside": _CASE_ARROW, "inside": _CASE_ARROW}
)
_CUT_ARROW = pa.schema(
    _PLACED | {"pos": pa.int64(), "head": pa.binary(), "record": pa.binary(), "ended": pa.bool_()}
)


def _marks(text: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of quotes; place and kind of braces and brackets, and whether an odd number of
    quotes stands before each. An escaped quote is none."""
    places = np.flatnonzero(_IS_MARK[text])
    kinds = text[places]
    quotes = kinds == _QUOTE
    slashes = places[kinds == _ESCAPE]
    if len(slashes):
        nth = np.arange(len(slashes))
        nth -= np.maximum.accumulate(np.where(np.diff(slashes, prepend=-2) != 1, nth, 0))
        quotes &= ~np.isin(places, slashes[nth % 2 == 0] + 1)
    odd = np.cumsum(quotes) % 2 == 1
    kept = (kinds != _QUOTE) & (kinds != _ESCAPE)
    return int(quotes.sum()), places[kept], kinds[kept], odd[kept]


def _nesting(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Braces and brackets open after each mark, counted from the first mark on."""
    braces = np.cumsum((kinds == _OPEN).astype(np.int64) - (kinds == _CLOSE))
    return braces, np.cumsum((kinds == _LEFT).astype(np.int64) - (kinds == _RIGHT))


def _adds(kinds: np.ndarray) -> dict:
    """What marks add to the nesting, and the objects that start and end at each level."""
    braces, brackets = _nesting(kinds)
    if not len(kinds):
        return {"braces": 0, "brackets": 0, "levels": []}
    starts = kinds == _OPEN
    at = starts | (kinds == _CLOSE)
    a, b = (braces - starts)[at], brackets[at]
    # Both as one number, which sorts faster than pairs.
    _, first, own = np.unique(a * (2 * len(kinds) + 1) + b, return_index=True, return_inverse=True)
    counts = [np.bincount(own[s], minlength=len(first)).tolist() for s in (starts[at], ~starts[at])]
    named = [
        {"braces": x, "brackets": y, "starts": s, "ends": e}
        for x, y, s, e in zip(a[first].tolist(), b[first].tolist(), *counts, strict=True)
    ]
    return {"braces": int(braces[-1]), "brackets": int(brackets[-1]), "levels": named}


def _chunks(batches):
    """Chunks of rows (file, block, value) that follow each other in a byte range."""
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, value = batch.column(0), batch.column(1).to_numpy(), batch.column(2).cast(pa.large_binary())
        ends = np.frombuffer(value.buffers()[1], np.int64)[value.offset : value.offset + len(value) + 1]
        data = np.frombuffer(value.buffers()[2], np.uint8)
        new = (block[1:] != block[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
        new |= np.diff((ends[1:] - ends[0]) // _CHUNK) > 0
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(value)]
        rows = []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            text = data[ends[i] : ends[j]]
            quotes, _, kinds, odd = _marks(text)
            place = {"file": file[i].as_py(), "block": int(block[i]), "n": n, "text": text.tobytes()}
            rows.append(place | {"quotes": quotes, "outside": _adds(kinds[~odd]), "inside": _adds(kinds[odd])})
            n += 1
        yield pa.RecordBatch.from_pylist(rows, _CHUNKS_ARROW)


def _cut(braces: int, brackets: int, whole: bool):
    """Records that lie in one chunk (``whole``), or the parts of those that may not."""

    def one(row: dict) -> tuple[list[int], list[bytes | None], list[bytes], list[bool]]:
        text, done = row["text"], row["done"]
        _, places, kinds, odd = _marks(np.frombuffer(text, np.uint8))
        own = odd == row["in_string"]
        places, kinds = places[own], kinds[own]
        a, b = _nesting(kinds)
        starts = kinds == _OPEN
        level = (a - starts + row["in_braces"] == braces) & (b + row["in_brackets"] == brackets)
        first = places[level & starts].tolist()
        last = (places[level & (kinds == _CLOSE)] + 1).tolist()
        # A record begun before goes on from the first byte.
        first = [0] * (row["begun"] > done) + first
        # What stands before the first record of a file is its head, which may be long.
        apart = (row["begun"] > done) or (done == 0)
        if whole:
            at = 1 if apart else 0
            records = [text[i:j] for i, j in zip(first[at:], last[at:], strict=False)]
            return list(range(done + at + 1, done + at + 1 + len(records))), [None] * len(records), records, [True] * len(records)
        parts = []
        if apart:
            end, start = (last or [len(text)])[0], (first or [len(text)])[0]
            parts.append((done + 1, text[:start], text[start:end], bool(last)))
        if len(first) > len(last) and not (apart and not last):
            parts.append((done + len(last) + 1, b"", text[first[-1] :], False))
        return tuple(map(list, zip(*parts, strict=True))) if parts else ([], [], [], [])

    def cut(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pos, heads, records, ended = one(row)
                columns = [pa.repeat(pa.scalar(row[k], kind), len(pos)) for k, kind in _PLACED.items()]
                columns += [pa.array(pos, pa.int64()), pa.array(heads, pa.binary()), pa.array(records, pa.binary()), pa.array(ended, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, schema=_CUT_ARROW)

    return cut


def json_records(spark: SparkSession, paths: str | Sequence[str], braces: int, brackets: int) -> DataFrame:
    """Rows (file, pos, head, record): every object that starts inside exactly ``braces``
    objects and ``brackets`` arrays, as its text.

    ``pos`` numbers the records of a file from 1; ``head`` is what stands before the first
    of them and null for the others. Values that are no objects are passed over. A document
    that is cut off inside a string, an array or an object raises. Only a record, or the
    head of a file, is gathered, never a file.
    """
    text = spark.read.option("lineSep", "}").text(paths)
    pieces = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.concat("value", F.lit("}")).cast("binary").alias("value"),
    )
    chunks = materialize(pieces.mapInArrow(_chunks, _CHUNKS), "chunks")
    # Rows of a window are chunks, so even a file of many gigabytes has few.
    near = Window.partitionBy("file").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, -1)

    def before(c: str) -> Column:
        return F.coalesce(F.sum(c).over(near), F.lit(0))

    seen = chunks.select("file", *_PLACE, "quotes", (before("quotes") % 2 == 1).alias("in_string"), "outside", "inside")
    seen = seen.withColumn("own", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    nested = seen.select("file", *_PLACE, "quotes", "in_string", "own.*")
    nested = nested.withColumns({"in_braces": before("braces"), "in_brackets": before("brackets")})
    level = F.filter(
        "levels",
        lambda x: (x["braces"] + F.col("in_braces") == braces) & (x["brackets"] + F.col("in_brackets") == brackets),
    )
    met = nested.withColumn("level", F.get(level, F.lit(0)))
    met = met.withColumns({k: F.coalesce(f"level.{k}", F.lit(0)) for k in ("starts", "ends")})
    where = met.withColumns({"begun": before("starts"), "done": before("ends")}).drop("levels", "level", "starts", "ends")
    where = materialize(where, "nested")
    # The text after the last brace is closed by none, so one too many is counted there.
    total = where.groupBy("file").agg(*[F.sum(c).alias(c) for c in ("quotes", "braces", "brackets")])
    complete = (F.col("brackets") == 0) & F.col("braces").isin(0, -1) & (F.col("quotes") % 2 == 0)
    guard(total, "records", [Guard("document is cut off", ~complete, SourceUnavailable)])
    state = where.select("file", *_PLACE, "in_string", "in_braces", "in_brackets", "begun", "done")
    placed = chunks.select("file", *_PLACE, "text").join(state, ["file", *_PLACE])
    texts = {k: F.col(k).cast("string") for k in ("head", "record")}
    whole = placed.mapInArrow(_cut(braces, brackets, True), _CUT).withColumns(texts)
    parts = placed.mapInArrow(_cut(braces, brackets, False), _CUT).withColumns(texts)
    joined = parts.groupBy("file", "pos").agg(
        F.sort_array(F.collect_list(F.struct(*_PLACE, "head", "record"))).alias("own"), F.max("ended").alias("ended")
    )
    joined = joined.where("ended").select(
        "file",
        "pos",
        F.when(F.col("pos") == 1, F.array_join("own.head", "")).alias("head"),
        F.array_join("own.record", "").alias("record"),
    )
    return whole.select("file", "pos", "head", "record").unionByName(joined)


@dataclass(frozen=True)
class Reader:
    """How a feed's documents are read: where its records stand and what one looks like.

    ``wrap`` turns an array of one record into the columns of a landed document, so that a
    record is a document of its own and all guards of the feed apply to it; its place in
    its file comes along as ``at``. ``total`` finds a declared number of records in the
    head of a file; fewer records then raise.
    """

    feed: Feed
    braces: int
    brackets: int
    element: str
    wrap: Callable[[Column], dict[str, Column]]
    total: str | None = None

    def documents(self, spark: SparkSession, paths: str | Sequence[str], **constants: str) -> DataFrame:
        own = self.wrap(F.array(F.from_json("record", self.element))) | {k: F.lit(v) for k, v in constants.items()}
        records = json_records(spark, paths, self.braces, self.brackets)
        records = records.select("file", F.col("pos").alias("at"), "head", *[v.alias(k) for k, v in own.items()])
        records = materialize(records, self.feed.source_id)
        if self.total:
            per_file = records.groupBy("file").agg(F.count("*").alias("n"), F.max("head").alias("head"))
            declared = F.regexp_extract("head", self.total, 1).try_cast("long")
            guard(per_file, self.feed.source_id, [Guard("truncated response", declared > F.col("n"), SourceUnavailable)])
        return records.drop("head")

    def load(self, spark: SparkSession, paths: str | Sequence[str], constants: dict[str, str] | None = None, **kw) -> DataFrame:
        """The feed's table. ``constants`` are columns a request adds to its documents."""
        documents = self.documents(spark, paths, **(constants or {}))
        return self.feed.load(documents, keep=lambda out: materialize(out, self.feed.source_id), **kw)
